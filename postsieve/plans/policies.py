"""The two shipped policies, as rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import body_size, get_header, get_spam_score
from ..functions.predicates import body_contains, regex_match
from ..operators.dlp import PATTERNS
from ..operators.policy import Policy, accept, add_header, bounce, fileinto, log_entry, quarantine, rule, set_dlp

# What the policies look for.
SPAM_SUBJECT = r"(?i)(viagra|cialis|casino|lottery|winner|prize)"
SPAM_PHRASES = ("click here now", "limited time offer")
TRUSTED_SENDER = r"@(example\.com|trusted\.org)$"
INTERNAL_SENDER = r"@company\.com$"
PHISHING_SUBJECT = r"(?i)(verify your account|suspended|urgent|act now)"
MOST_BYTES = 52_428_800
COMPLIANCE = "compliance@company.com"


def spam_policy(subject: str = SPAM_SUBJECT, phrases: tuple[str, ...] = SPAM_PHRASES, trusted: str = TRUSTED_SENDER, score: float = 7.0) -> Policy:
    sender = get_header("From")
    phrase = F.lit(False)
    for p in phrases:
        phrase = phrase | body_contains(p)
    return Policy(
        [
            rule(True, log_entry(F.concat(F.lit("Checking message from: "), sender))),
            rule(get_spam_score() > score, log_entry(F.concat(F.lit("High spam score: "), get_spam_score().cast("string"))), quarantine(), stop=True),
            rule(regex_match(subject, get_header("Subject")), log_entry("Spam keywords detected in subject"), fileinto("Spam"), stop=True),
            rule(phrase, log_entry("Suspicious content in body"), fileinto("Spam"), stop=True),
            rule(regex_match(trusted, sender), log_entry("Trusted sender domain"), add_header("X-Trusted", "yes"), accept(), stop=True),
            rule(True, accept(), stop=True),
        ]
    )


def corporate_policy(internal: str = INTERNAL_SENDER, phishing: str = PHISHING_SUBJECT, most_bytes: int = MOST_BYTES, card: str = PATTERNS["card"], ssn: str = PATTERNS["ssn"]) -> Policy:
    sender = get_header("From")
    external = ~regex_match(internal, sender)
    body = F.col("body")
    return Policy(
        [
            rule(external, log_entry(F.concat(F.lit("External email from: "), sender)), add_header("X-External-Mail", "yes")),
            rule(body_size() > most_bytes, log_entry(F.concat(F.lit("Large attachment blocked: "), body_size().cast("string"), F.lit(" bytes"))), bounce(), stop=True),
            rule(regex_match(card, body), log_entry("Credit card pattern detected"), set_dlp("quarantine", COMPLIANCE), stop=True),
            rule(regex_match(ssn, body), log_entry("SSN pattern detected"), set_dlp("quarantine", COMPLIANCE), stop=True),
            rule(external & regex_match(phishing, get_header("Subject")), log_entry("Potential phishing email"), fileinto("Quarantine"), stop=True),
            rule(True, accept(), stop=True),
        ]
    )
