"""Document type and place from a title, Column to Column."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words looked for in the lower-case title, in this order, and the type each gives.
TYPES = (
    (("debate",), "Debate"),
    (("remarks", "speech"), "Speech/Remarks"),
    (("interview",), "Interview"),
    (("statement",), "Statement"),
    (("address",), "Address"),
)
OTHER = "Document"


def document_type(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F.lit(OTHER)
    for words, kind in reversed(TYPES):
        hit = low.contains(words[0])
        for word in words[1:]:
            hit = hit | low.contains(word)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


# The phrases that announce a place, in order. As written, the gap between words is a literal
# backslash followed by letters s, so that a place has one word in practice.
_LEADS = ("in", "at the")
_GAP = r"\\s+"
_GAP_INTENDED = r"\s+"


def location(title: Column, multiword: bool = False) -> Column:
    """The first capitalised word, or words with ``multiword``, after 'in' or else 'at the'; '' if none."""
    gap = _GAP_INTENDED if multiword else _GAP
    place = f"([A-Z][a-z]+(?:{gap}[A-Z][a-z]+)*)"
    found = [F.nullif(F.regexp_extract(title, f"{lead} {place}", 1), F.lit("")) for lead in _LEADS]
    return F.coalesce(*found, F.lit(""))
