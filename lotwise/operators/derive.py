"""Derived columns of listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Auction types and their names.
AUCTION_TYPES = {16: "expiry auction", 20: "buynow", 38: "expiry auction", 39: "closeout"}
# Categories by how a part of the label begins, the first that matches.
CATEGORIES = {
    "ai": "ai|ml|llm|gpt|nlp|neural|deeplearn|genai|intelli",
    "healthcare": "health|med|clinic|hospital|pharma|doctor|care|dental|therapy|wellness",
    "fintech": "fin|bank|pay|crypto|trade|invest|fund|wealth|loan|lending|defi|forex",
    "legal": "law|legal|attorney|court|lawyer|notary|counsel|litigation",
    "tech": "tech|software|app|code|dev|cloud|saas|api|digital|platform|cyber",
    "real-estate": "realt|estate|home|house|propert|mortgage|reit|realtor",
    "ecommerce": "shop|store|ecommerce|retail|market|deal|merch|brand|goods",
}


def auction_type_name(type_id: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in AUCTION_TYPES.items() for x in kv])[type_id], F.lit("other"))


def expiry_status(sold: Column, ends_at: Column, as_of, soon_days: int = 7) -> Column:
    days = F.datediff(ends_at, F.lit(as_of))
    return F.when(sold == 1, "sold").when(ends_at < F.lit(as_of), "expired").when(days <= soon_days, "expiring_soon").otherwise("active")


def category_name(label: Column) -> Column:
    """Empty where no part of the label (they end at - and _) begins with a category's words."""
    out = F.when(label.isNull(), "")
    for name, words in CATEGORIES.items():
        out = out.when(F.lower(label).rlike(f"(^|[-_])({words})"), name)
    return out.otherwise("")


def hold_days(start: str, end: str) -> Column:
    """Days between two times by their dates, 0 at least; NULL if either is missing."""
    days = F.datediff(F.col(end), F.col(start))
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days))


_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "MM/dd/yyyy"]


def any_time(text: Column) -> Column:
    """A timestamp from text in one of several formats, or from an epoch number; else NULL."""
    parsed = [F.try_to_timestamp(text, F.lit(f)) for f in _FORMATS]
    return F.coalesce(*parsed, F.timestamp_seconds(text.try_cast("double")))


def age_years(text: Column, as_of) -> Column:
    """Whole years of 365 days, 0 at least; NULL if the text is no date."""
    days = F.datediff(F.lit(as_of), any_time(text))
    return F.when(days.isNotNull(), F.greatest(F.lit(0), F.floor(days / 365)).cast("int"))
