"""Typed filters as columns, and the listing predicate."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_range(col: str, start, end) -> Column:
    """Closed on both sides."""
    return F.col(col).between(F.lit(start), F.lit(end))


def equality(col: str, value) -> Column:
    return F.col(col) == F.lit(value)


def numeric_range(col: str, low=None, high=None) -> Column:
    if low is None and high is None:
        raise ValueError("a range needs a bound")
    if high is None:
        return F.col(col) >= low
    return F.col(col) <= high if low is None else F.col(col).between(low, high)


def in_list(col: str, values) -> Column:
    if not values:
        raise ValueError("an empty list of values")
    return F.col(col).isin(*values)


def conjunction(filters: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, filters, F.lit(True))


_SLOT = re.compile(r"(\w+)=(\S+)")


def from_hint(hint: str, numeric: dict[str, str], lists: dict[str, str]) -> Column:
    """A predicate from text like ``price_min=500 tld=com,net``; slots that name no column are skipped, as are values that aren't numbers."""
    out = []
    for slot, value in _SLOT.findall(hint):
        stem, _, end = slot.rpartition("_")
        if end in ("min", "max") and stem in numeric:
            try:
                number = float(value)
            except ValueError:
                continue
            out.append(numeric_range(numeric[stem], low=number) if end == "min" else numeric_range(numeric[stem], high=number))
        elif slot in lists and (values := [v for v in value.split(",") if v]):
            out.append(in_list(lists[slot], values))
    return conjunction(out)


def segments(sld: Column) -> Column:
    return F.split(F.lower(sld), "-")


def keyword(sld: Column, term: str, mode: str = "contains") -> Column:
    """``starts`` and ``ends`` look at the label, ``exclude`` at its segments' ends; ``contains`` wants a whole segment or a unit of letters, not followed by its own
    last consonant doubled."""
    term = term.lower()
    low = F.lower(sld)
    if mode == "starts":
        return low.startswith(term)
    if mode == "ends":
        return low.endswith(term)
    if mode == "exclude":  # short terms at either end of a segment, long ones anywhere
        at = re.escape(term)
        return low.rlike(f"(^|-){at}|{at}(-|$)") if len(term) <= 5 else F.contains(low, F.lit(term))
    guard = f"($|[^{re.escape(term[-1])}])" if term[-1].isalpha() and term[-1] not in "aeiou" else ""
    return F.array_contains(segments(sld), term) | low.rlike(f"(^|[^a-z0-9]){re.escape(term)}{guard}")


#: Slots that bound a column from below and above, and the column: NULL excludes.
RANGES = {
    "price": "price", "bids": "bids", "quality": "quality", "traffic": "traffic", "authority": "authority", "govalue": "govalue", "age": "age_years", "backlinks": "backlinks", "buy_it_now": "buy_it_now_price",
    "majestic_tf": "majestic_tf", "majestic_cf": "majestic_cf", "majestic_backlinks": "majestic_backlinks", "majestic_ref_domains": "majestic_ref_domains", "tlf_keyword_regs": "tlf_keyword_regs",
    "semrush_backlinks": "semrush_backlinks", "semrush_indexed_pages": "semrush_indexed_pages", "semrush_ref_domains": "semrush_ref_domains", "semrush_search_volume": "semrush_search_volume",
    "semrush_authority": "semrush_authority_score", "semrush_cpc": "semrush_cpc",
}
#: Slots that are true or false, and the column (of 0 and 1): NULL excludes.
FLAGS = {"tlf_exact_match": "tlf_exact_match", "tlf_developed": "tlf_developed", "buy_it_now": "buy_it_now", "has_reserve_price": "has_reserve_price", "gd_transfer": "gd_transfer"}
#: Slots that bound a time; a NULL ``listed_at`` passes, a NULL ``ends_at`` doesn't.
TIMES = {"listed_after": ("listed_at", ">="), "listed_before": ("listed_at", "<="), "ends_after": ("ends_at", ">="), "ends_before": ("ends_at", "<=")}
_OWN_LABEL = {"has_hyphen": "-", "has_number": "[0-9]", "is_idn": "^xn--|[^\\x00-\\x7F]"}


def expand_types(wanted: list, names: dict[int, str]) -> list[int]:
    """Type ids from ids and from names, which may stand for several ids."""
    low = [str(w).lower() for w in wanted]
    return sorted({i for i, n in names.items() if str(i) in low or n.lower() in low} | {int(w) for w in low if w.isdigit()})


def build_predicate(filters: dict, as_of: datetime | None = None, sld: str = "sld", columns: dict[str, str] | None = None) -> Column:
    """The listing predicate. NULL excludes, but a NULL ``listed_at`` passes; a negative price counts as unknown.

    Slots: X_min / X_max for X in RANGES; those of FLAGS; those of TIMES; tlds, exclude_tlds; types, exclude_types (ids or names);
    contains_any, contains_all, exclude_keywords, starts_any, ends_any, phrase; name_length_min / _max, word_count_min / _max; has_hyphen,
    has_number, is_idn; letters_min / _max, digits_min / _max; exclude_letters; gem; unknown (columns that must be NULL; a range on one of them
    is then left out); has_traffic (columns of which one must be above 0); time_remaining_max (seconds); days_listed_min, days_listed_max;
    lifecycle (types) with lifecycle_or_ends_before, or with ``lifecycle_disjunction``: the types or the remaining time.
    """
    from lotwise.operators.derive import AUCTION_TYPES

    name = lambda c: (columns or {}).get(c, c)
    col = lambda c: F.col(name(c))
    label, now = F.lower(F.col(sld)), F.lit(as_of)
    strip = lambda ts: [t.lower().lstrip(".") for t in ts]
    typed = lambda ts: col("type_id").isin(*expand_types(ts, AUCTION_TYPES))
    count = lambda pattern: F.regexp_count(label, F.lit(pattern))
    unknown = set(filters.get("unknown", ()))

    def remaining(most: float) -> Column:
        left = F.unix_timestamp(col("ends_at")) - F.unix_timestamp(now)
        return left.isNotNull() & left.between(0, most)

    either = bool(filters.get("lifecycle_disjunction"))
    out: list[Column] = []
    if either:
        sides = [remaining(filters["time_remaining_max"])] if "time_remaining_max" in filters else []
        sides += [typed(filters["lifecycle"])] if "lifecycle" in filters else []
        out.append(reduce(lambda a, b: a | b, sides, F.lit(False)))
    for slot, value in filters.items():
        stem, _, end = slot.rpartition("_")
        bound = (lambda c, v=value, e=end: c >= v if e == "min" else c <= v) if end in ("min", "max") else None
        if either and slot in ("lifecycle", "time_remaining_max"):
            continue
        if bound and stem in RANGES:
            if RANGES[stem] in unknown:
                continue
            c = col(RANGES[stem])
            if stem == "price":
                c = F.when(c >= 0, c)
            out.append(c.isNotNull() & bound(c))
        elif slot in FLAGS:
            out.append(F.coalesce(col(FLAGS[slot]).cast("int") == int(bool(value)), F.lit(False)))
        elif bound and stem == "name_length":
            out.append(bound(F.length(label)))
        elif bound and stem == "word_count":
            out.append(bound(F.size(F.regexp_extract_all(label, F.lit("([a-z]+|[0-9]+)"), 1))))
        elif bound and stem in ("letters", "digits"):
            out.append(bound(count(r"\p{L}" if stem == "letters" else "[0-9]")))
        elif slot in ("tlds", "exclude_tlds"):
            hit = F.ltrim(F.lower(col("tld")), F.lit(".")).isin(*strip(value))
            out.append(hit if slot == "tlds" else ~hit)
        elif slot in ("types", "exclude_types"):
            out.append(typed(value) if slot == "types" else ~typed(value))
        elif slot in ("contains_any", "contains_all", "starts_any", "ends_any", "exclude_keywords"):
            hits = [keyword(F.col(sld), t, slot.split("_")[0]) for t in value]
            both = reduce((lambda a, b: a & b) if slot == "contains_all" else (lambda a, b: a | b), hits)
            out.append(~both if slot == "exclude_keywords" else both)
        elif slot == "phrase":
            out.append(F.contains(F.replace(label, F.lit("-"), F.lit("")), F.lit(re.sub("[ -]", "", value.lower()))))
        elif slot in _OWN_LABEL:
            hit = label.rlike(_OWN_LABEL[slot])
            out.append(hit if value else ~hit)
        elif slot == "exclude_letters":
            out.append(~label.rlike(f"[{re.escape(''.join(value).lower())}]"))
        elif slot == "gem":
            out.append(F.coalesce(col("gem").cast("boolean"), F.lit(False)) if value else F.lit(True))
        elif slot == "unknown":
            out += [col(c).isNull() for c in value]
        elif slot == "has_traffic":
            out.append(F.greatest(*[F.coalesce(col(c), F.lit(0)) for c in value], F.lit(0)) > 0)
        elif slot == "time_remaining_max":
            out.append(remaining(value))
        elif slot in TIMES:
            c, op = TIMES[slot]
            hit = col(c) >= F.lit(value) if op == ">=" else col(c) <= F.lit(value)
            out.append(col(c).isNull() | hit if c == "listed_at" else hit)
        elif slot in ("days_listed_min", "days_listed_max"):
            days = F.datediff(now, col("listed_at"))
            out.append(days.isNull() | bound(days))
        elif slot == "lifecycle":
            before = filters.get("lifecycle_or_ends_before")
            out.append(typed(value) | (col("ends_at") <= F.lit(before)) if before else typed(value))
        elif slot not in ("lifecycle_or_ends_before", "lifecycle_disjunction"):
            raise ValueError(f"no such slot: {slot}")
    return conjunction(out)


def below_market(listings: DataFrame, baselines: DataFrame, price: str = "price", tld: str = "tld") -> DataFrame:
    """Rows priced under their TLD's baseline, else under the one named ``_global``; without baselines all rows; unpriced rows fail."""
    from lotwise.operators.sizes import small

    base = baselines.select(F.col("tld").alias("__tld"), F.col("baseline").alias("__b"))
    overall = baselines.where("tld = '_global'").agg(F.max("baseline").alias("__g"), F.lit(True).alias("__x"))
    joined = listings.join(small(base), F.col(tld) == F.col("__tld"), "left").join(F.broadcast(overall), F.lit(True), "left")
    known = F.coalesce("__b", "__g")
    return joined.where(known.isNull() | ((F.col(price) > 0) & (F.col(price) < known))).select(*listings.columns)


def conflicts(filters: DataFrame, ranges: list[str], lists: list[str]) -> DataFrame:
    """Filter sets that contradict themselves: X_min above X_max, or a value both wanted and excluded."""
    found = [F.when(F.col(f"{r}_min") > F.col(f"{r}_max"), F.lit(r)) for r in ranges]
    found += [F.when(F.arrays_overlap(F.col(c), F.col(f"exclude_{c}")), F.lit(c)) for c in lists]
    return filters.withColumn("conflicts", F.array_compact(F.array(*found)))


def hour_partition(start: datetime, end: datetime, prefix: str = "") -> Column:
    """[start, end) on partition columns year, month, day, hour: as one number, so that pruning sees a range of each."""
    stamp = sum(F.col(f"{prefix}{c}") * m for c, m in (("year", 1_000_000), ("month", 10_000), ("day", 100), ("hour", 1)))
    number = lambda t: t.year * 1_000_000 + t.month * 10_000 + t.day * 100 + t.hour
    last = number(end) if (end.minute or end.second or end.microsecond) else number(end) - 1
    return F.col(f"{prefix}year").between(start.year, end.year) & stamp.between(number(start), last)


def blocklist(text: Column, banned: list[str], cap: int = 16) -> Column:
    """struct(flagged, terms): the banned tokens of a text, ``cap`` at most."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))
    terms = F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(b) for b in banned])))
    return F.struct((F.size(terms) > 0).alias("flagged"), F.slice(terms, 1, cap).alias("terms"))


EMAIL, PHONE, CARD = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\+?\d{0,2} ?\(\d{3}\) \d{3}-\d{4}", r"\b\d{13,16}\b"


def nfkc(text: Column) -> Column:
    """Compatible forms made one; ICU comes with Spark."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def sanitize(text: Column, max_chars: int, blocked: list[str]) -> Column:
    """struct(text, reasons): NFKC, personal data masked in the whole text; reasons say what was met, and none means passed. A NULL gives an
    empty text."""
    plain = nfkc(F.coalesce(text, F.lit("")))
    masked = reduce(lambda c, p: F.regexp_replace(c, p, "[REDACTED]"), (EMAIL, PHONE, CARD), plain)
    low, met = F.lower(plain), [b.lower() for b in blocked if b]
    said = reduce(lambda a, b: a | b, [F.contains(low, F.lit(b)) for b in met], F.lit(False))
    reasons = [
        F.when(text.isNull(), F.lit("non_string_input")),
        F.when(text.isNotNull() & (F.length(plain) == 0), F.lit("empty_input")),
        F.when(F.length(plain) > max_chars, F.lit(f"length_exceeds_{max_chars}")),
        F.when(said, F.lit("blocked_pattern_matched")),
        F.when(masked != plain, F.lit("pii_detected")),
    ]
    return F.struct(masked.alias("text"), F.array_compact(F.array(*reasons)).alias("reasons"))


def fragment_mask(text: Column, max_chars: int, unsafe: Column, mask: str = "[REMOVED]") -> Column:
    """The mask where ``unsafe``, else the text cut at ``max_chars`` with a mark."""
    return F.when(unsafe, F.lit(mask)).when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("[TRUNCATED]"))).otherwise(text)
