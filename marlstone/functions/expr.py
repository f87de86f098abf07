"""Native column functions: names, hosts, tokens, dates, pay, and display."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings on the wire, after lower-casing and dropping all but letters and digits.
EMPLOYMENT = {"fulltime": "full_time", "parttime": "part_time", "contract": "contract", "intern": "intern", "temporary": "temporary"}
EMPLOYMENT_LEVER = EMPLOYMENT | {"ft": "full_time", "pt": "part_time", "contractor": "contract", "fixedterm": "contract", "fulltimefreelance": "contract", "internship": "intern", "temp": "temporary"}
WORKPLACE = {"onsite": "onsite", "hybrid": "hybrid", "remote": "remote"}
WORKPLACE_GEM = {"hybrid": "hybrid", "remote": "remote", "in_office": "onsite"}
INTERVALS = {"per-year-salary": "year", "per-month-salary": "month", "per-week-salary": "week", "per-day-wage": "day", "per-hour-wage": "hour"}
#: Hosts of public boards, each with its source and the name of its form of address.
BOARD_HOSTS = {
    "boards.greenhouse.io": ("greenhouse", "greenhouse_boards"),
    "job-boards.greenhouse.io": ("greenhouse", "greenhouse_job_boards"),
    "jobs.lever.co": ("lever", "lever"),
    "jobs.ashbyhq.com": ("ashby", "ashby"),
    "apply.workable.com": ("workable", "workable"),
    "jobs.gem.com": ("gem", "gem"),
}
#: Fixed value: every customer of this source has a host of its own below this one.
WORKDAY_DOMAIN = "myworkdayjobs.com"
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Fixed value: the form of a slug.
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"
INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_name(c: Column) -> Column:
    """Letters and digits of any script, lower-cased; null stays null."""
    return F.lower(F.regexp_replace(c, r"(?U)[^\p{Alnum}]", ""))


def url_host(c: Column) -> Column:
    """Lower-cased host of an http(s) address without user, one leading www. and port; anything else is null, so it joins nothing."""
    place = F.lower(F.substring_index(F.regexp_extract(c, "(?i)^https?://([^/?#]*)", 1), "@", -1))
    host = F.regexp_replace(F.regexp_replace(place, ":[0-9]+$", ""), r"^www\.(?=.)", "")
    return F.when(host.rlike(r"^\[.+\]$|^[^:\[\]]+$"), host)


def path_escape(c: Column) -> Column:
    """Percent-escapes for one segment of a path: all but letters, digits and what a segment may hold as it is."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), *((f"%{ord(x):02X}", x) for x in "$&+=:@~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def join_non_empty(sep: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), sep)


def lookup(values: Mapping[str, str], key: Column) -> Column:
    """The value of a key, null if it isn't known."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def employment(c: Column, values: Mapping[str, str] = EMPLOYMENT) -> Column:
    return F.when(c.isNotNull(), lookup(values, F.coalesce(alnum_key(c), F.lit(""))))


def workplace(c: Column, values: Mapping[str, str] = WORKPLACE) -> Column:
    return F.when(c.isNotNull(), lookup(values, F.lower(c)))


def pay(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """struct(min, max, currency, period), all or nothing: a known interval, three letters, 0 < min <= max; whole units."""
    code = F.upper(F.trim(currency))
    period = F.when(interval.isNotNull(), lookup(INTERVALS, interval))
    sound = period.isNotNull() & code.rlike("^[A-Z]{3}$") & (low > 0) & (high > 0) & (high >= low)
    return F.when(sound, F.struct(low.cast("long").alias("min"), high.cast("long").alias("max"), code.alias("currency"), period.alias("period")))


def epoch_ms(c: Column) -> Column:
    return F.timestamp_millis(F.nullif(c, F.lit(0).cast("long")))


def instant(c: Column) -> Column:
    """An RFC 3339 instant, null if it isn't one in full."""
    return F.when(c.rlike(INSTANT), F.try_to_timestamp(F.regexp_replace(F.upper(c), "Z$", "+00:00")))


def day(c: Column) -> Column:
    """Midnight of a plain date, null if it isn't one."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c))


def day_or_instant(c: Column) -> Column:
    return F.coalesce(instant(c), day(c))


def posted_on(c: Column, today: Column) -> tuple[Column, Column]:
    """(midnight of the day meant, whether the wording is known): a date, today, yesterday, N days ago; 'N+' is known but open."""
    text = F.lower(F.trim(c))
    days = F.try_to_number(F.nullif(F.regexp_extract(text, r"^posted\s+(\d{1,6})\s+days? ago$", 1), F.lit("")), F.lit("999999"))
    open_ended = text.rlike(r"^posted\s+\S*\+\s+days? ago$")
    date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text).cast("date"))
    date = F.coalesce(date, F.when(text == "posted today", today), F.when(text == "posted yesterday", F.date_sub(today, 1)), F.date_sub(today, days.cast("int")))
    return date.cast("timestamp"), F.coalesce(date.isNotNull() | open_ended, F.lit(False))


def normalize_board_token(ats: Column, token: Column) -> Column:
    """Case rule of each source: three ignore case, one only in its host, the others keep what they get."""
    host = F.substring_index(token, "/", 1)
    return F.when(ats.isin("greenhouse", "ashby", "workable"), F.lower(token)).when(ats == "workday", F.concat(F.lower(host), F.substring(token, F.length(host) + 1, F.length(token)))).otherwise(token)


def only(c: Column, characters: str) -> Column:
    """Whether a string has no other character, whatever the case."""
    return F.translate(F.lower(c), characters, "") == ""


def detect_board(url: Column) -> Column:
    """struct(ats, board_token, pattern) of an address on a known host, else null.

    The token is the first part of the path; where hosts are customers' own, it is the host with the first part behind
    a language (en, en-US), if there is one and something follows it.
    """
    scheme = F.substring_index(url, "://", 1)
    address = F.substring(url, F.length(scheme) + 4, F.length(url))
    parts = F.split(F.substring_index(F.substring_index(address, "?", 1), "#", 1), "/")
    host, first, second = F.lower(F.get(parts, F.lit(0))), blank_to_null(F.get(parts, F.lit(1))), blank_to_null(F.get(parts, F.lit(2)))
    codes = F.split(first, "-")
    language = (F.size(codes) <= 2) & F.forall(codes, lambda x: (F.length(x) == 2) & only(x, LETTERS))
    site = F.when(language, F.coalesce(second, first)).otherwise(first)
    found = lambda ats, token, pattern: F.struct(F.lit(ats).alias("ats"), normalize_board_token(F.lit(ats), token).alias("board_token"), F.lit(pattern).alias("pattern"))
    own = host.endswith(f".{WORKDAY_DOMAIN}") & (F.length(host) > len(WORKDAY_DOMAIN) + 1) & only(host, LETTERS + DIGITS + ".-")
    out = F.when(own, found("workday", F.concat_ws("/", host, site), "workday"))
    for known, (ats, pattern) in BOARD_HOSTS.items():
        out = out.when(host == known, found(ats, first, pattern))
    return F.when(F.lower(scheme).isin("http", "https") & first.isNotNull(), out)


def token_valid(ats: Column, token: Column) -> Column:
    parts = F.split(token, "/")
    labels = F.split(F.get(parts, F.lit(0)), r"\.")
    label = lambda x: x.rlike("^[a-z0-9-]+$") & ~x.startswith("-") & ~x.endswith("-")
    host = (F.size(labels) >= 3) & (F.array_join(F.slice(labels, -2, 2), ".") == WORKDAY_DOMAIN) & F.forall(labels, label)
    workday = (F.size(parts) == 2) & host & F.get(parts, F.lit(1)).rlike("^[^/?#]+$")
    known = ats.isin("greenhouse", "lever", "ashby", "workday", "workable", "gem")
    return F.coalesce((token != "") & known & F.when(ats == "workday", F.coalesce(workday, F.lit(False))).when(ats == "workable", token.rlike(SLUG)).otherwise(F.lit(True)), F.lit(False))


def url_valid(c: Column) -> Column:
    """An absolute http(s) address with a host, no control character and no stray percent sign."""
    return F.coalesce(c.rlike(r"(?i)^https?://[^/?#\s]+") & ~c.rlike(r"[\x00-\x1F\x7F]") & ~c.rlike("%(?![0-9A-Fa-f]{2})"), F.lit(False))


def strip_code_fence(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, each padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(c), r"(?U)[^\p{Alnum}]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_codes(grams: Column) -> Column:
    """Trigrams as whole numbers, 21 bits for each character: the same sets, which compare faster."""
    at = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("long")
    return F.transform(grams, lambda g: at(g, 1) * (1 << 42) + at(g, 2) * (1 << 21) + at(g, 3))


def similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams, rounded through single precision; 0 if there is none at all."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(both, either), F.lit(0.0)).cast("float").cast("double")


def percent_text(share: Column) -> Column:
    """Whole per cent; what isn't quite none or all doesn't say so."""
    pct = share * 100
    return F.when((pct > 0) & (pct < 1), F.lit("<1%")).when((pct < 100) & (pct >= 99.5), F.lit("99%")).otherwise(F.concat(F.floor(pct + 0.5).cast("string"), F.lit("%")))


def exact_count(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n, 0)


def compact_count(n: Column) -> Column:
    """A whole number: exact below 10,000, else in thousands, millions and so on with a tenth where it isn't nought; halves go up."""
    out = exact_count(n)
    for size, unit in ((1_000, "K"), (1_000_000, "M"), (1_000_000_000, "B"), (1_000_000_000_000, "T")):
        tenths = F.floor((n + size // 20) / (size // 10)).cast("long")
        text = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""), F.lit(unit))
        out = F.when(n >= (10_000 if size == 1_000 else size - size // 20_000), text).otherwise(out)
    return out


def rate_text(rate: Column) -> Column:
    """A rate for each day: whole from ten on, with a tenth below, and plain 0 for none."""
    return F.when(rate == 0, F.lit("0")).when(rate >= 10, F.floor(rate + 0.5).cast("string")).otherwise(F.format_number(rate, 1))


def ago(at: Column, now: Column) -> Column:
    """How long before (or after) now, in the largest unit of which one is full; null without a time."""
    seconds = F.unix_millis(at) - F.unix_millis(now)
    out = F.lit("just now")
    units = (("minute", 60, None), ("hour", 3_600, None), ("day", 86_400, ("yesterday", "tomorrow")), ("month", 2_592_000, ("last month", "next month")), ("year", 31_536_000, ("last year", "next year")))
    for name, size, single in units:
        n = F.floor(F.abs(seconds) / (size * 1000)).cast("long")
        amount = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
        text = F.when(seconds < 0, F.concat(amount, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), amount))
        if single:
            text = F.when(n == 1, F.when(seconds < 0, single[0]).otherwise(single[1])).otherwise(text)
        out = F.when(n >= 1, text).otherwise(out)
    return F.when(at.isNotNull() & now.isNotNull(), out)


def workplace_label(resolved: Column, source: Column) -> Column:
    """A workplace type with where it is from; null without either."""
    told = F.when(source.isin("ats", "raw_data"), " (reported)").when(source == "location_text", " (derived from location)")
    return F.concat(F.upper(F.substring(resolved, 1, 1)), F.substring(resolved, 2, 100), told)
