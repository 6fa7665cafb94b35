"""Streams of values, laid one after another without objects around them, as rows of a lateral table function."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pdf

VALUES = "place int, kind string, value string, start int, stop int, error string"


def kind_of(value: object) -> str:
    if value is None:
        return "Null"
    if isinstance(value, bool):
        return "Boolean"
    if isinstance(value, int):
        return "Integer"
    if isinstance(value, float):
        return "Real"
    if isinstance(value, list):
        return "Array"
    if isinstance(value, dict):
        return "Reference" if set(value) == {"R"} else "Dictionary"
    return "Name" if value.startswith("/") else "String"


@F.udtf(returnType=VALUES)
class ValueStream:
    def eval(self, content):
        data, at, place = bytes(content or b""), 0, 0
        while True:
            m = pdf.TOKEN.search(data, at)
            while m and m[0].startswith(b"%"):
                m = pdf.TOKEN.search(data, m.end())
            if not m:
                return
            try:
                value, end = pdf.parse_value(data, m.start())
                if value is pdf._END_DICT or value is pdf._END_ARRAY:
                    raise pdf.PdfError("a closing bracket without its opening one")
            except pdf.DAMAGE as e:
                yield place, None, None, m.start(), len(data), str(e)
                return
            yield place, kind_of(value), json.dumps(value, ensure_ascii=False), m.start(), end, None
            place, at = place + 1, end


def value_streams(rows: DataFrame, content: str = "content") -> DataFrame:
    """``rows`` with (``VALUES``) for every value of their binary ``content``, in order.

    What cannot be read ends a stream: its last row then has an error and no value, and
    the values before it stay. Null and empty contents, and comments alone, have no row.
    Rows that repeat have their values each.
    """
    whole: Column = F.col(content)
    return rows.lateralJoin(ValueStream(whole.outer()))
