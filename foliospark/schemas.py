"""Explicit schemas of the tables; nothing is inferred."""

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FETCH = _struct(url=_S, status=_I, error=_S, html=_S, fetched_at=T.TimestampType())

DOCUMENT_LISTING = _struct(Date=_S, Title=_S, Document_Link=_S, Related_Category=_S, Related_Link=_S, Page=_I, URL_Page_Index=_I)

DEBATE_LISTING = _struct(Date=_S, Title=_S, Debate_Link=_S, Related_Category=_S, Related_Link=_S)

DOCUMENT_DETAIL = _struct(
    Document_Title=_S, Document_Date=_S, Document_Content=_S, Speaker=_S, Speaker_Title=_S,
    Document_Type=_S, Location=_S, Video_Available=_B, Word_Count=_L, Extraction_Status=_S,
)

DEBATE_DETAIL = _struct(
    URL=_S, Extracted_Title=_S, Extracted_Date=_S,
    Participants_List=T.ArrayType(_S), Participants=_S, Moderators_List=T.ArrayType(_S), Moderators=_S,
    Debate_Content_Text=_S, Debate_Content_HTML=_S,
)

#: State of the resumable enrichment: one row per processed link.
EXTRACTED = T.StructType([T.StructField("url", _S), *DOCUMENT_DETAIL.fields, T.StructField("processed_at", T.TimestampType())])
