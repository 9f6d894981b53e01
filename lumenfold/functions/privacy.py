"""Classification of private URLs and redaction of credentials, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.identity import url_part

#: Services, host labels and paths whose pages are private.
SUFFIXES = (
    "mail.google.com outlook.com outlook.office.com mail.yahoo.com proton.me protonmail.com fastmail.com zoho.com chase.com bankofamerica.com wellsfargo.com citi.com paypal.com stripe.com wise.com revolut.com coinbase.com "
    "mychart.com myhealth.va.gov healthcare.gov nhs.uk labcorp.com questdiagnostics.com irs.gov ssa.gov gov.uk/account id.me"
).split()
LABELS = "mail webmail banking bank secure portal patient billing payroll admin intranet vpn sso auth login account accounts wallet health medical ehr".split()
PATHS = "/account /accounts /billing /invoice /statement /settings/security /checkout /payment /transfer /patient /records /payroll /admin".split()
INTERNAL = (".localhost", ".local", ".internal", ".lan")
CREDENTIALS = "token access_token id_token refresh_token auth session sessionid sid key api_key apikey password pwd secret signature sig".split()


def classify_url(url: Column) -> Column:
    """The first rule that makes a URL private (``internal_host``, ``service``, ``label``, ``path``, ``credentials``), or null."""
    host, path, user = F.lower(url_part(url, 3)), F.lower(url_part(url, 5)), url_part(url, 2)
    internal = ~host.contains(".") | host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | (host == "localhost")
    for s in INTERNAL:
        internal = internal | host.endswith(s)
    service = F.lit(False)
    for s in SUFFIXES:
        service = service | (host == s) | host.endswith("." + s) | F.concat(host, path).startswith(s)
    parts = F.split(host, r"\.")
    label = F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x.isin(*LABELS))
    secret = F.lit(False)
    for p in PATHS:
        secret = secret | (path == p) | path.startswith(p + "/")
    return F.when(host == "", None).when(internal, "internal_host").when(service, "service").when(label, "label").when(secret, "path").when(user != "", "credentials")


def redact_url(url: Column) -> Column:
    """The URL without user info and credential parameters."""
    bare = F.regexp_replace(url, r"^(https?://)[^/?#@]*@", "$1")
    names = "|".join(CREDENTIALS)
    gone = F.regexp_replace(bare, rf"(?i)(?<=[?&])(?:{names})=[^&#]*&?", "")
    return F.regexp_replace(gone, r"[?&]+(?=#|$)", "")


_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: What is redacted, in this order, and what takes its place.
PATTERNS = (
    ("email", rf"{_B}[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]*[A-Za-z0-9_]{_E}", "[email]"),
    ("bearer_token", rf"(?i){_B}(?:bearer|token|api[_-]?key|secret)\s*[:=]\s*\S+", "[token]"),
    ("long_hex", rf"(?i){_B}[0-9a-f]{{32,}}{_E}", "[hex]"),
    ("jwt", rf"{_B}eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*[A-Za-z0-9_]{_E}", "[jwt]"),
)
CARD = rf"({_B}(?:[0-9][ -]?){{12,18}}[0-9]{_E})"


def luhn(card: Column) -> Column:
    """Whether 13 to 19 digits, separators aside, carry a valid check digit."""
    digits = F.regexp_replace(card, "[^0-9]", "")
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.length(digits).between(13, 19) & (F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0)


def redact(text: Column) -> tuple[Column, dict[str, Column]]:
    """Redacted text and the number of redactions of each kind; each pattern sees the result of the one before."""
    counts = {}
    for kind, pattern, put in PATTERNS:
        counts[kind] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, put.replace("[", "\\[").replace("]", "\\]"))
    cards = F.filter(F.regexp_extract_all(text, F.lit(CARD)), luhn)
    counts["card_number"] = F.size(cards)
    return F.aggregate(cards, text, lambda t, c: F.replace(t, c, F.lit("[card]"))), counts
