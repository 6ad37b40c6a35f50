"""Small tables with every hazard: nulls, empty and long texts, ties,
repeated rows, clashing extra columns."""

from __future__ import annotations

DOCS_DDL = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [
    "", " ", "\n", "  two  spaces ", "tab\tand\r\nlines\n\n", "x" * 5000, "word " * 4000,
    "<|endoftext|> and <|startoftext|>", "café café Ångström İstanbul Σίσυφος",
    "你好世界 こんにちは", "emoji \U0001f600\U0001f468‍\U0001f469", "▁low▁line ▁",
    "a\x1cb\x1fc !\x1c! \x85next \xa0nbsp em", "nul\x00byte", "1,234.56 12345 ½ ²", "it's we'll I'VE they'd",
    "MiXeD CASE Mixed case", "mixed case MIXED CASE", "﻿bom", "a  b   c    d", "#*$%&|<>",
]


def odd_docs() -> list[tuple]:
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100, None, None, None, None), (None, "no id here", "de", None, 3), (None, None, None, "s", 0)]
    rows += [(200, "same row twice", "en", "s", 1)] * 2
    rows += [(201, "same text", "en", "s", 1), (202, "SAME text", "fr", "t", 1), (203, "same text", None, "s", 1)]
    return rows


def frame(spark, rows, ddl: str = DOCS_DDL):
    return spark.createDataFrame(rows, ddl)


def clashing(docs):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("kept", "h", "n", "norm", "row", "hub", "shard", "grp", "d2", "length", "piece", "_idx", "_part",
                 "ids", "part", "keep_id", "tokens", "__t", "__new"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def rows_of(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]
