"""Normalising names, predicates, URLs and texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that end a company's name.
SUFFIXES = (
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "PLC", "LLC", "LP", "SA", "NV", "AG", "SE",
    "HOLDINGS", "HOLDING", "GROUP", "SPA", "SRL", "AB", "ASA", "AS", "OYJ", "GMBH", "BV", "SAS", "SL", "PTE", "PTY", "KK", "KGAA", "AKTIENGESELLSCHAFT",
)


def norm(name: Column) -> Column:
    """Upper case, & as AND, other characters as blanks, blanks squeezed."""
    upper = F.replace(F.upper(name), F.lit("&"), F.lit(" AND "))
    return F.trim(F.regexp_replace(upper, "[^A-Z0-9]+", " "))


def strip_suffix(name: Column) -> Column:
    """The normalised name without trailing legal forms and single letters, and without one leading THE."""
    bare = F.trim(F.regexp_replace(norm(name), f"(?:(?:^| )(?:{'|'.join(SUFFIXES)}|[A-Z0-9]))+$", ""))
    return F.regexp_replace(bare, "^THE(?: |$)", "")


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(norm(name), " "), lambda w: F.left(w, F.lit(1))), "")


def predicate_key(predicate: Column) -> Column:
    """Lower case, runs of other characters as underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(predicate), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def host_of(url: Column) -> Column:
    """Lower-case host, without user, port and trailing dot."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")


def normalize_url(url: Column) -> Column:
    """Scheme added, host lower-cased, fragment, user, default port, tracking parameters and trailing slash dropped.

    '' for what is no http(s) URL or has no dot in its host.
    """
    full = F.trim(url)
    full = F.when(full.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), full).otherwise(F.concat(F.lit("https://"), full))
    scheme = F.lower(F.regexp_extract(full, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = host_of(full)
    port = F.regexp_extract(full, r"^[^/]*//(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)", 1)
    kept_port = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_extract(full, r"^[^/]*//[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(full, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid|ref|ref_src)="))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(scheme.isin("http", "https") & F.contains(host, F.lit(".")), F.concat(scheme, F.lit("://"), host, kept_port, path, rest)).otherwise("")


def is_private_host(host: Column) -> Column:
    """Hosts that are never fetched: single labels, and addresses in private, loopback, link-local and reserved ranges."""
    four = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    private = host.rlike(r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^192\.0\.[02]\.|^198\.(1[89]|51\.100)\.|^203\.0\.113\.|^2(2[4-9]|[3-5]\d)\.")
    return ~F.contains(host, F.lit(".")) | (four & private)


def snippet(text: Column, needle: Column, width: int) -> Column:
    """``width`` characters to either side of the first match, whatever its case; else the text's head."""
    at = F.position(F.lower(needle), F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - width), F.least(at - 1, F.lit(width)) + F.length(needle) + width)).otherwise(F.substring(text, 1, 2 * width))


def context_line(title: Column, source: Column, date: Column) -> Column:
    """"title — source, date", leaving out what is missing."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" — ", F.coalesce(blank(title), F.lit("Untitled")), F.nullif(F.concat_ws(", ", blank(source), blank(date)), F.lit("")))


def format_literal(value: Column, currency: Column, as_of: Column) -> Column:
    """"value currency (as_of=…)", leaving out nulls."""
    return F.concat_ws(" ", value, currency, F.when(as_of.isNotNull(), F.concat(F.lit("(as_of="), as_of, F.lit(")"))))


def date_of(text: Column) -> Column:
    """RFC 822, else ISO, else a leading date; '' if none."""
    rfc = F.to_date(F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z")))
    return F.coalesce(F.date_format(rfc, "yyyy-MM-dd"), F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


#: Characters from the start of a text within which its header must end.
HEADER_SCAN = 16_384


def _rule(text: Column) -> Column:
    """Where the rule below a header begins (from 1); null if the text has no header."""
    first = F.substring_index(text, "\n", 1)
    inner = F.position(F.lit("\n---\n"), text)
    last = F.when(F.endswith(text, F.lit("\n---")) & (F.length(text) <= HEADER_SCAN), F.length(text) - 3)
    return F.when(first.startswith("# ") & F.contains(first, F.lit(":")), F.when((inner > 0) & (inner + 4 <= HEADER_SCAN), inner).otherwise(last))


def header_of(text: Column) -> Column:
    """Map of the "# key: value" lines above a line "---"; empty without one.

    Other lines go on with the value above them, and of a repeated key the last counts.
    """
    head = F.substring(text, F.lit(1), F.coalesce(_rule(text), F.lit(1)) - 1)
    lines = F.split(F.regexp_replace(head, r"\s*\n(?!# [^\n]*:)[^\S\n]*", " "), "\n")
    pairs = F.transform(F.filter(lines, lambda x: x.rlike("^# [^:]*:")), lambda x: F.struct(F.trim(F.regexp_extract(x, "^# ([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, "(?s)^# [^:]*:(.*)$", 1)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.when(_rule(text).isNotNull(), F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


def body_of(text: Column) -> Column:
    """The text below its header, without line ends around it."""
    rule = _rule(text)
    return F.btrim(F.when(rule.isNotNull(), F.substring(text, rule + 5, F.length(text))).otherwise(text), F.lit("\n"))
