"""The thin queries that apply each operator to its whole table, and SQL for the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, lexical, licenses, lmscore, mix, ngramjoin, pii, quality, shards, simhash, spelling, urlfilter
from .common import table, word_count


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n_words"))
    mixed = mix.mix_sources(docs, F.col("n_words"), columns=["doc_id"])
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        "source_size",
        F.col("source_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"),
        "mix_shards",
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("select -1L conv_id, 0L turn, 'user' role, '' text union all select -1L, 1L, 'assistant', ''").withColumn("text", F.lit(said))
    return chat.read_back(chat.format_turns(turns.unionByName(extra))).drop("n_tokens")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Rules of the URL query, as text: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    # the listed URLs: those of the pages whose id is divisible by 50
    judged = urlfilter.filter_urls(pages, rules, pages.where("page_id % 50 = 0").select("url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


#: The key of the query over the test tables. A corpus needs one of its own, from where secrets are kept.
TEST_KEY = "postsieve"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.pseudonymize(docs, TEST_KEY)
    kinds = F.array_join(F.transform("pii", lambda x: x["kind"]), ",")
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), kinds.alias("kinds"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept", "distance")


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the base rules of the quality query rest on."""
    rows = table(spark, sf_dir, "documents").select("doc_id", quality.stats("text").alias("stats"))
    counts = [F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *counts, quality.base_failed(F.col("stats")).alias("base_failed"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables have no paths: a document is a file in the folder of its source, language and a bucket of ids, and every
    # document whose id is divisible by 50 is the license file of its bucket, or of one of the folders above
    folder = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.lit("b"), F.pmod("doc_id", F.lit(7))))
    depth = F.pmod(F.floor(F.col("doc_id") / 50), F.lit(3)).cast("int")
    place = F.when(F.col("doc_id") % 50 == 0, F.concat(F.array_join(F.slice(F.split(folder, "/"), F.lit(1), depth + 1), "/"), F.lit("/LICENSE"))).otherwise(F.concat(folder, F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", "text", place.alias("path"))
    return licenses.scan_licenses(files, ["doc_id"])


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_jaccard_join(table(spark, sf_dir, "documents"))


_SHARD_KEYS = ["doc_id", "text_md5"]


def _sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).alias("n_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, size = _sized_documents(spark, sf_dir), F.col("n_bytes") + 1
    mapping, _ = shards.stored_map(docs, _SHARD_KEYS, size, 8)
    put = shards.shard_by_slots(docs, _SHARD_KEYS, size, mapping=mapping)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def shard_map_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions 0 and 1 of the map of ``documents``, as they are in its table: the second has a ninth shard."""
    mapping, path = shards.stored_map(_sized_documents(spark, sf_dir), _SHARD_KEYS, F.col("n_bytes") + 1, 8)
    shards.store_map(shards.grown(mapping), path)
    return shards.load_map(spark, path, 0).unionByName(shards.load_map(spark, path)).select("version", F.col("slot").alias("vslot"), "shard", "bytes")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_chat": op2_chat,
    "op3_decontamination": op3_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_pii": op5_pii,
    "op6_lm_score": op6_lm_score,
    "op8_licenses": op8_licenses,
    "op7_quality": op7_quality,
    "op9_ngram_join": op9_ngram_join,
    "op10_shards": op10_shards,
    "op11_spelling": op11_spelling,
    "op12_lexical": op12_lexical,
    "op13_simhash": op13_simhash,
    "shard_map_grown": shard_map_grown,
    "text_counts": text_counts,
}

_TURNS_SQL = r"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS r, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS t FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(17 + length(r) + length(t)) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id"""

#: The shingles of a table's texts: runs of five words, or all words of a shorter text.
_SHINGLES_SQL = r"""SELECT DISTINCT {id} AS id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM (
  SELECT {id}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT {id}, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM {table}) WHERE len(w) > 0)"""

_CONTAINED_SQL = f"""WITH d AS ({_SHINGLES_SQL.format(id="doc_id", text="text", table="documents")}),
b AS ({_SHINGLES_SQL.format(id="item_id", text="text", table="benchmark")}), n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared, any_value(n.n) AS item_shingles, count(*) / any_value(n.n) AS containment
FROM b JOIN d USING (s) JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n.n) - 1e-9"""

_JOIN_SQL = f"""WITH RECURSIVE d AS MATERIALIZED ({_SHINGLES_SQL.format(id="doc_id", text="text", table="documents")}), n AS MATERIALIZED (SELECT id, count(*) AS n FROM d GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS n_both FROM d a JOIN d b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE n_both >= 0.8 * (x.n + y.n - n_both) - 1e-9),
reach AS (SELECT a AS id, a AS to_id FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a),
classes AS (SELECT id, min(to_id) AS class_id FROM reach GROUP BY id), degrees AS (SELECT a AS id, count(*) AS k FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(k, 0) AS n_links, coalesce(n, 0) AS n_shingles
FROM documents LEFT JOIN classes c ON c.id = doc_id LEFT JOIN degrees g ON g.id = doc_id LEFT JOIN n ON n.id = doc_id"""

_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_URL_SQL = rf"""WITH cut AS (SELECT page_id, url, contains(url, '://') AS has,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '{urlfilter.TRACKING}'))) AS args FROM pages),
forms AS (SELECT *, CASE WHEN has THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS form FROM cut),
rules(verdict, h, p) AS (VALUES {_RULES_SQL}),
fits AS (SELECT DISTINCT url, first_value(h || p) OVER o AS rule, first_value(verdict) OVER o AS verdict FROM (SELECT DISTINCT url, host, path FROM forms) f
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) WINDOW o AS (PARTITION BY url ORDER BY length(h || p) DESC, h || p)),
listed AS (SELECT DISTINCT form FROM forms WHERE page_id % 50 = 0 AND form IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN form IN (SELECT form FROM listed) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(form IN (SELECT form FROM listed), false) AS listed
FROM forms LEFT JOIN fits USING (url)"""

_MAP_SQL = """WITH RECURSIVE used AS (
  SELECT CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(31) || md5(coalesce(text, ''))), 1, 3) AS INTEGER) AS vslot, sum(strlen(coalesce(text, '')) + 1) AS bytes FROM documents GROUP BY 1),
slots AS MATERIALIZED (SELECT CAST(r.s AS INTEGER) AS vslot, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, row_number() OVER (ORDER BY coalesce(bytes, 0) DESC, r.s) AS k FROM range(4096) r(s) LEFT JOIN used ON used.vslot = r.s),
deal AS (SELECT CAST(0 AS BIGINT) AS k, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS load, -1 AS vslot, CAST(-1 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS bytes
  UNION ALL SELECT s.k, list_transform(d.load, lambda x, i: CASE WHEN i = list_position(d.load, list_min(d.load)) THEN x + s.bytes ELSE x END), s.vslot, list_position(d.load, list_min(d.load)) - 1, s.bytes
  FROM deal d JOIN slots s ON s.k = d.k + 1),
first AS (SELECT vslot, CAST(shard AS INTEGER) AS shard, bytes FROM deal WHERE k > 0),
held AS (SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY md5(CAST(vslot AS VARCHAR)), vslot ROWS UNBOUNDED PRECEDING) AS given, sum(bytes) OVER (PARTITION BY shard) AS own, sum(bytes) OVER () AS total FROM first)
SELECT 0 AS version, vslot, shard, bytes FROM first
UNION ALL SELECT 1, vslot, CASE WHEN given <= own - total / 9 THEN 8 ELSE shard END, bytes FROM held"""

_V = f"(SELECT greatest({lmscore.SYMBOLS}, count(*) + 2) FROM singles)"
#: Character trigrams of all documents, two smoothed models with background counts scaled to the target's, and mean losses.
_LM_SQL = f"""WITH good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, d.doc_id, regexp_extract_all(text, '(?s).') AS c, g.doc_id IS NOT NULL AS t FROM documents d LEFT JOIN good g ON g.doc_id = d.doc_id),
grams AS MATERIALIZED (SELECT r, t, CASE WHEN i > 2 THEN c[i - 2] ELSE '' END AS x, CASE WHEN i > 1 THEN c[i - 1] ELSE '' END AS y, c[i] AS z FROM (SELECT r, t, c, unnest(range(1, len(c) + 1)) AS i FROM docs)),
cells AS MATERIALIZED (SELECT x, y, z, count(*) FILTER (t) AS t, count(*) FILTER (NOT t) AS o FROM grams GROUP BY x, y, z),
pairs AS MATERIALIZED (SELECT y, z, sum(t) AS t, sum(o) AS o FROM cells GROUP BY y, z), singles AS MATERIALIZED (SELECT z, sum(t) AS t, sum(o) AS o FROM pairs GROUP BY z),
known AS MATERIALIZED (SELECT CAST(sum(t) AS DOUBLE) AS n, CASE WHEN sum(o) > 0 THEN sum(t) / sum(o) ELSE 0 END AS s, CASE WHEN sum(o) > 0 THEN CAST(sum(t) AS DOUBLE) ELSE 0 END AS m, CAST({_V} AS DOUBLE) AS v FROM singles),
firsts AS (SELECT y, sum(t) AS t, sum(o) AS o FROM pairs GROUP BY y), contexts AS (SELECT x, y, sum(t) AS t, sum(o) AS o FROM cells GROUP BY x, y),
two AS MATERIALIZED (SELECT p.y, p.z, (p.t + {lmscore.PRIOR} * (u.t + 1) / (n + v)) / (f.t + {lmscore.PRIOR}) AS t, (s * p.o + {lmscore.PRIOR} * (s * u.o + 1) / (m + v)) / (s * f.o + {lmscore.PRIOR}) AS o FROM pairs p JOIN singles u USING (z) JOIN firsts f ON f.y = p.y, known),
losses AS MATERIALIZED (SELECT c.x, c.y, c.z, -ln((c.t + {lmscore.PRIOR} * two.t) / (k.t + {lmscore.PRIOR})) AS t, -ln((s * c.o + {lmscore.PRIOR} * two.o) / (s * k.o + {lmscore.PRIOR})) AS o FROM cells c JOIN two ON two.y = c.y AND two.z = c.z JOIN contexts k ON k.x = c.x AND k.y = c.y, known),
means AS (SELECT r, count(*) AS n, round(avg(l.t), 6) AS t, round(avg(l.o), 6) AS o FROM grams g JOIN losses l ON l.x = g.x AND l.y = g.y AND l.z = g.z GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_tokens, means.t AS target_loss, means.o AS background_loss, means.t - means.o AS difference FROM docs LEFT JOIN means USING (r)"""

_COUNTS_SQL = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
repeats AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE n > 1) GROUP BY r),
counts AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN repeats USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts"""

_TERMS_SQL = r"SELECT {id}, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM {table}"
_SEARCH_SQL = f"""WITH counts AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM ({_TERMS_SQL.format(id="doc_id", table="documents")}) GROUP BY doc_id, term),
lengths AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id), whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
items AS MATERIALIZED (SELECT DISTINCT item_id, term FROM ({_TERMS_SQL.format(id="item_id", table="benchmark")})),
weights AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole WHERE term IN (SELECT term FROM items) GROUP BY term),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""

#: The others have hashes, draws or estimates that SQL cannot express; tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_chat": _TURNS_SQL, "op3_decontamination": _CONTAINED_SQL, "op4_url_filter": _URL_SQL, "op6_lm_score": _LM_SQL, "op9_ngram_join": _JOIN_SQL, "op12_lexical": _SEARCH_SQL, "shard_map_grown": _MAP_SQL, "text_counts": _COUNTS_SQL}
