"""Identity and canonicalisation of records, as column expressions.

All regular expressions spell ASCII classes out, since Java's ``\\b`` and ``\\s`` differ from the
definitions these rules are stated in.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space trimmed from identifiers (that of ECMAScript).
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
#: The shape of a DOI and the punctuation that is never its end.
DOI_SHAPE = r"(?i)(?<![A-Za-z0-9_])(10\.[0-9]{4,9}/[-._;()/:a-z0-9<>+\[\]]+)"
DOI_TAIL = r"""[.,;:)\]>'"]+$"""


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normal_doi(c: Column) -> Column:
    """Lower-case DOI without resolver prefix or trailing punctuation; null where there is none."""
    s = strip(c)
    s = F.regexp_replace(s, r"(?i)^https?://(dx\.)?doi\.org/", "")
    s = F.regexp_replace(s, f"(?i)^doi:{SPACE}*", "")
    s = F.regexp_replace(s, r"(?i)^info:doi/", "")
    found = F.regexp_replace(F.regexp_extract(s, DOI_SHAPE, 1), DOI_TAIL, "")
    return F.when(found.rlike("(?s)/."), F.lower(found))


def doi_url(c: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), c)


def arxiv_doi(url: Column) -> Column:
    """DOI registered for an arXiv abs/pdf URL, version dropped; null for other URLs."""
    ident = F.regexp_extract(url, r"(?i)arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})", 1)
    return F.when(ident != "", F.concat(F.lit("10.48550/arxiv."), ident))


#: Query parameters that only track, prefixes of whole families of them, and those of single hosts.
TRACKING = (
    "fbclid gclid gclsrc dclid msclkid twclid yclid igshid mc_cid mc_eid ml_subscriber ml_subscriber_hash vero_id vero_conv oly_enc_id oly_anon_id "
    "_ga _gl _hsenc _hsmi hsctatracking ref_src ref_url spm scm share_id wt_zmc icid cmpid campaign_id"
).split()
TRACKING_PREFIXES = ("utm_", "pk_", "mtm_", "piwik_", "matomo_", "hsa_")
HOST_TRACKING = {
    "youtube.com": ("si", "pp", "feature", "ab_channel"),
    "youtu.be": ("si", "feature"),
    "open.spotify.com": ("si", "nd", "context"),
    "twitter.com": ("s", "t"),
    "x.com": ("s", "t"),
    "amazon.com": ("ref", "psc", "th", "tag"),
    "medium.com": ("source", "sk"),
}
URL_SHAPE = r"(?i)^(https?)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(url: Column, n: int) -> Column:
    """Group n of an absolute http(s) URL: 1 scheme, 2 credentials, 3 host, 4 port, 5 path, 6 query."""
    return F.regexp_extract(strip(url), URL_SHAPE, n)


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(url_part(url, 3)), r"^www\.", "")


def _tracks(host: Column, pair: Column) -> Column:
    name = F.lower(F.substring_index(pair, "=", 1))
    own = [(host == h) & name.isin(*names) for h, names in HOST_TRACKING.items()]
    out = name.isin(*TRACKING)
    for p in TRACKING_PREFIXES:
        out = out | name.startswith(p)
    for o in own:
        out = out | o
    return out


def canonical_url(url: Column) -> Column:
    """https, lower-case host without ``www.``, no default port, fragment, tracking parameters, repeated or trailing
    slashes; parameters sorted by name, in their order where names repeat.  Null for what is no absolute http(s) URL.
    Percent-escapes are kept as they are."""
    host, port, path, query = url_host(url), url_part(url, 4), url_part(url, 5), url_part(url, 6)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~_tracks(host, p))
    order = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
    tail = F.array_join(F.transform(order, lambda s: s["p"]), "&")
    path = F.regexp_replace(path, "/{2,}", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(F.lit("/"))
    whole = F.concat(F.lit("https://"), host, F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), path, F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))
    return F.when(strip(url).rlike(URL_SHAPE), whole)


def dropped_params(url: Column) -> Column:
    host = url_host(url)
    return F.transform(F.filter(F.split(url_part(url, 6), "&"), lambda p: (p != "") & _tracks(host, p)), lambda p: F.substring_index(p, "=", 1))


def same_document(a: Column, b: Column) -> Column:
    return F.coalesce(canonical_url(a) == canonical_url(b), F.lit(False))


def source_id(doi: Column, url: Column, content: Column) -> Column:
    """Deterministic id from the strongest key that is there; null where there is none."""
    of = lambda tag, pre, c: F.when(c.isNotNull(), F.concat(F.lit(f"s-{tag}-"), F.substring(F.sha2(F.concat(F.lit(pre), c), 256), 1, 24)))
    return F.coalesce(of("doi", "doi:", normal_doi(doi)), of("url", "url:", canonical_url(url)), of("cnt", "content:", content))


def resolved_doi(url: Column) -> Column:
    """DOI named by a URL, directly or by an arXiv id."""
    return F.coalesce(normal_doi(url), arxiv_doi(url))


@F.pandas_udf(StringType())
def fold_text(s: pd.Series) -> pd.Series:
    """NFKC, lower case, white space runs to one space, trimmed."""
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).lower().split()))


def fingerprint(text: Column) -> Column:
    """Hash of the folded text.  ASCII texts are folded in the JVM, only others visit Python."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\s]+", " "))
    return F.sha2(F.when(text.rlike(r"[^\x00-\x7f]"), fold_text(text)).otherwise(plain), 256)


@F.pandas_udf(StringType())
def compose(s: pd.Series) -> pd.Series:
    """NFKC."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def folded(c: Column) -> Column:
    """Lower case, NFKC; only texts with characters above ASCII visit Python."""
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7f]"), compose(low)).otherwise(low)


def local_key(form: Column) -> Column:
    """Stable slug id of a concept of the user's own; full-width letters and ligatures count as what they stand for."""
    slug = F.regexp_replace(F.regexp_replace(folded(form), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(slug != "", F.concat(F.lit("local:"), slug))


_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid_millis(c: Column) -> Column:
    """Milliseconds encoded in a ULID; null for what is none."""
    value = F.aggregate(F.split(F.substring(F.upper(c), 1, 10), ""), F.lit(0).cast("long"), lambda a, x: F.when(x == "", a).otherwise(a * 32 + F.position(x, F.lit(_BASE32)) - 1))
    return F.when(c.rlike("(?i)^[0-7][0-9A-HJKMNP-TV-Z]{25}$"), value)
