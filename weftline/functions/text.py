"""Entity-name, delimited-set, URL and date expressions. All are Column to Column and stay in the JVM.

A missing text is the empty text here, never null, unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text cleaners see it: Unicode's, so a no-break space counts.
WS = "(?U)\\s+"


def squash(c: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), WS, "")


def clean(c: Column) -> Column:
    """Runs of white space become one blank; both ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS, " "))


def strip_only(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)^\\s+|\\s+$", "")


def clean_link_text(c: Column) -> Column:
    """clean() without a leading `Continue to `."""
    return F.regexp_replace(clean(c), "(?i)^Continue to\\s+", "")


def alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]+", "")


def key_squashed(c: Column) -> Column:
    """Key A: lower-cased, & spelt out, letters and digits only, which leaves no white space either."""
    return alnum(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit("and")))


def has_key(c: Column) -> Column:
    """Whether key_squashed() leaves anything of a text; false or null if not."""
    return F.lower(c).rlike("[a-z0-9&]")


def _spelt(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(clean(c)), F.lit("&"), F.lit(" and ")), "[™®]", "")


def words_pattern(words: Sequence[str]) -> str:
    """Any of some words (longest first) between word boundaries."""
    return "\\b(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")\\b"


def key_trimmed(c: Column, retail: Sequence[str], legal: Sequence[str]) -> Column:
    """Key B: cleaned, & spelt out, marks, retail words and then legal words dropped, letters and digits only."""
    out = _spelt(c)
    for words in (retail, legal):
        if words:
            out = F.regexp_replace(out, words_pattern(words), "")
    return alnum(out)


def key_plain(c: Column) -> Column:
    """Key C: as key B, but no words are dropped."""
    return alnum(_spelt(c))


def key_lower(c: Column) -> Column:
    """Key D: lower-cased letters and digits."""
    return alnum(F.lower(F.coalesce(c, F.lit(""))))


def name_tokens(c: Column, legal: Sequence[str]) -> Column:
    """Array of lower-cased tokens, & spelt out, without legal ones."""
    parts = F.split(F.regexp_replace(F.replace(F.lower(strip_only(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "), " ")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(list(legal)))


def token_name(c: Column, legal: Sequence[str]) -> Column:
    return F.array_join(name_tokens(c, legal), " ")


def key_tokens(c: Column, legal: Sequence[str]) -> Column:
    """Key E: the token name without blanks."""
    return F.array_join(name_tokens(c, legal), "")


def useful_tokens(c: Column, legal: Sequence[str], generic: Sequence[str]) -> Column:
    """Distinct tokens of two letters and more that are neither legal nor generic."""
    return F.array_distinct(F.filter(name_tokens(c, legal), lambda t: (F.length(t) > 1) & ~t.isin(list(generic))))


def ticker(c: Column) -> Column:
    return F.replace(F.upper(strip_only(c)), F.lit("."), F.lit("-"))


def spaced_name(c: Column) -> Column:
    """Blanks put between camel-case words and between letters and digits; the text itself if nothing is left."""
    t = strip_only(c)
    for pattern in ("(?<=[a-z])(?=[A-Z])", "(?<=[A-Z])(?=[A-Z][a-z])", "(?<=[A-Za-z])(?=[0-9])", "(?<=[0-9])(?=[A-Za-z])"):
        t = F.regexp_replace(t, pattern, " ")
    t = clean(t)
    return F.when(t == "", F.coalesce(c, F.lit(""))).otherwise(t)


def friendly_name(c: Column, names: dict[str, str] | None = None) -> Column:
    """A name as people search for it: from names if it is there, else & spelt out, + a blank, no final .com, no marks, and split as spaced_name() does."""
    t = clean(c)
    out = F.regexp_replace(F.replace(F.replace(t, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" ")), "(?i)\\.com$", "")
    out = clean(spaced_name(F.regexp_replace(out, "[™®]", "")))
    return F.coalesce(renamed(t, names), out) if names else out


def renamed(c: Column, names: dict[str, str]) -> Column:
    """The new name of a text that has one in a short list, else null."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[c]


def country_hint(c: Column) -> Column:
    """What a search adds for a country: ` UK`, ` US` or nothing."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.contains(low, F.lit("united kingdom")), " UK").when(F.contains(low, F.lit("united states")), " US").otherwise("")


#: Spellings of countries.
COUNTRIES = {
    "UnitedStates": "United States", "United States": "United States", "USA": "United States", "US": "United States", "UnitedKingdom": "United Kingdom", "United Kingdom": "United Kingdom",
    "UK": "United Kingdom", "Canada(En)": "Canada", "Canada(Fr)": "Canada",
}


def country_items(c: Column, names: dict[str, str] = COUNTRIES) -> Column:
    """The items of a delimited set of countries, each once, in one spelling."""
    return unique_items(F.transform(split_items(c), lambda x: F.coalesce(renamed(x, names), x)))


def first_filled(*cs: Column) -> Column:
    """The first text that isn't blank, else the empty text."""
    return F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in cs], F.lit(""))


def filled(*cs: Column, fallback: Column | None = None) -> Column:
    """Distinct texts that aren't blank, in order; the fallback alone if there is none."""
    found = F.array_distinct(F.filter(F.array(*[clean(c) for c in cs]), lambda x: x != ""))
    return found if fallback is None else F.when(F.size(found) > 0, found).otherwise(F.filter(F.array(clean(fallback)), lambda x: x != ""))


def cache_key(key: Column, *rest: Column) -> Column:
    return F.sha1(F.concat_ws("||", key, *[F.lower(clean(c)) for c in rest]))


def split_items(c: Column) -> Column:
    """The cleaned, non-empty items of a list delimited by ; | or a comma."""
    return F.filter(F.transform(F.split(clean(c), "[;|,]"), lambda x: F.trim(x)), lambda x: x != "")  # clean() has left single blanks only


def joined_sorted(items: Column, sep: str = "; ") -> Column:
    """The distinct non-blank items of an array in order, joined."""
    return F.array_join(F.sort_array(F.array_distinct(F.array_remove(items, ""))), sep)


def unique_items(items: Column) -> Column:
    """Items once each whatever their case, with the first spelling, in order of first sight."""
    low = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def truthy(c: Column) -> Column:
    """t, true, y, yes and 1 in any case are true, all else (also `1.0`, blank and null) false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("t", "true", "y", "yes", "1"), F.lit(False))


def is_http(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^https?://"), F.lit(False))


def domain(c: Column) -> Column:
    """Host and port in lower case without www.; the scheme may be missing; blank for what isn't a URL."""
    t = strip_only(c)
    url = F.when(t == "", None).when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    host = F.regexp_extract(url, "^https?://([^/?#]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), "^www\\.", ""), F.lit(""))


def slug(c: Column, part: str = "stores?") -> Column:
    """The path segment after /store/ or /stores/."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), f"/{part}/([^/?#]+)", 1)


def last_slug(c: Column, part: str = "stores") -> Column:
    """The last path segment if `part` is the one before it and not the first."""
    path = F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    return F.regexp_extract(path, f"^.*/[^/]*/{part}/([^/]+)$", 1)


def blocked_domain(url: Column, parts: Sequence[str]) -> Column:
    """True where the domain holds one of some parts, and where there is none."""
    d = domain(url)
    return (d == "") | contains_any(d, parts)


def domain_score(name: Column, url: Column, retail: Sequence[str], legal: Sequence[str]) -> Column:
    """How well a domain fits a name: 5 for equal keys, 4 for the name within, 3 for the domain within (of four signs at least), else the
    name's words of three letters that it holds. `com`, `co` and `net` are taken out of the domain wherever they stand."""
    own, core = key_trimmed(name, retail, legal), alnum(domain(url))
    for part in ("com", "co", "net"):
        core = F.replace(core, F.lit(part), F.lit(""))
    tokens = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)
    return (
        F.when((own == "") | (core == ""), 0).when(own == core, 5).when(F.contains(core, own), 4)
        .when(F.contains(own, core) & (F.length(core) >= 4), 3).otherwise(F.size(F.filter(tokens, lambda t: F.contains(core, t))))
    )


def within_domains(dom: Column, domains: Sequence[str]) -> Column:
    """Equal to one of some domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (dom == d) | dom.endswith("." + d)
    return out


#: The query keys that hold a redirect's target, in order of preference.
REDIRECT_KEYS = ("dest_url", "url", "redirect_url", "merchant_url", "target")


def _unescaped(c: Column) -> Column:
    """Percent escapes resolved; what isn't an escape stays as it is."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def redirect_target(url: Column, keys: Sequence[str] = REDIRECT_KEYS) -> Column:
    """The first query value among keys that is itself a http URL once its escapes are resolved, twice as many are; blank for none."""
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    found = []
    for k in keys:
        once = _unescaped(F.nullif(F.regexp_extract(query, f"(?:^|&){k}=([^&]+)", 1), F.lit("")))
        found.append(_unescaped(F.replace(once, F.lit("+"), F.lit("%2B"))))
    return F.coalesce(*[F.when(is_http(x), x) for x in found], F.lit(""))


def parse_date(c: Column) -> Column:
    """yyyy-mm-dd or yyyy/m/d; null for what is neither."""
    t = strip_only(c)
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd")), F.try_to_timestamp(t, F.lit("yyyy/M/d"))).cast("date")


def parse_date_strict(c: Column) -> Column:
    """parse_date() that raises for text which is no date."""
    t = strip_only(c)
    return F.when(t == "", None).otherwise(F.coalesce(parse_date(c), F.raise_error(F.concat(F.lit("not a date: "), t)).cast("date")))


def display_date(d: Column) -> Column:
    return F.date_format(d, "yyyy/M/d")


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def quarter_index(d: Column) -> Column:
    return (F.year(d) * 4 + F.quarter(d)).cast("long")


def before_marker(c: Column, marker: str) -> Column:
    return F.rtrim(F.substring_index(F.coalesce(c, F.lit("")), marker, 1))


def number(c: Column, kind: str = "double") -> Column:
    """The number, 0 for what is none."""
    return F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))


def guarded(c: Column) -> Column:
    """A leading apostrophe for text that a spreadsheet would run as a formula."""
    return F.when(c.rlike("^[=+\\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def card_fields(c: Column) -> Column:
    """Struct of a card's lines: title, subtitle, and the rest joined by ` - `."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), clean), lambda x: x != "")
    return F.struct(
        F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")).alias("title"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("subtitle"),
        F.array_join(F.slice(lines, 3, 1_000_000), " - ").alias("rest"),
    )


def phrase_count(text: Column, phrase: str) -> Column:
    """Occurrences of a phrase (in lower case, without blanks at its ends): as a substring if it has a blank, -, ' or & then, else between
    other than letters and digits; none of a blank phrase. text must be in lower case."""
    phrase = phrase.lower().strip()
    if not phrase:
        return F.lit(0).cast("long")
    if any(s in phrase for s in " -'&"):
        n = (F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)
        return F.when(F.contains(text, F.lit(phrase)), n.cast("long")).otherwise(F.lit(0).cast("long"))
    return F.regexp_count(text, F.lit("(?<![a-z0-9])\\Q" + phrase + "\\E(?![a-z0-9])")).cast("long")


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first class of an ordered rule list of which a keyword is a substring of text."""
    if not rules:
        return F.lit(default)
    return F.coalesce(*[F.when(contains_any(text, words), F.lit(name)) for name, words in rules], F.lit(default))
