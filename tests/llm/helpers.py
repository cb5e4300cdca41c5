"""Small document tables with the awkward rows every operator must take."""

from __future__ import annotations

import os

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, words string, row int, bits string, record string, prompt string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def frame(spark, texts):
    """Documents of (doc_id, text) with further columns whose names clash with the operators' own."""
    rows = [(i, t, None, "s", None, "x", "h", None, 3, "b", None, "p") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "one"),
    (5, "Alpha beta  gamma\nAlpha beta  gamma\nline three of it"),
    (6, "Alpha beta gamma Alpha beta gamma line three of it"),
    (7, "Alpha beta  gamma\nAlpha beta  gamma\nline three of it"),
    (8, LONG),
    (9, LONG),
    (10, "ñandú Größe 日本語 テスト 🎉 a\x1cb  x İ ΑΣ"),
    (11, "it's <|endoftext|> here <|start|>user<|text|>x<|end|> \\ back\\slash [INST] </s>"),
    (11, "it's <|endoftext|> here <|start|>user<|text|>x<|end|> \\ back\\slash [INST] </s>"),
    (None, "a row without an id"),
]


def input_dir(spark, folder, docs=None, labels=None, conversations=None) -> str:
    """A folder of tables as the queries read them."""
    for name, df in (("documents", docs), ("labels", labels), ("conversations", conversations)):
        if df is not None:
            df.write.parquet(os.path.join(str(folder), f"{name}.parquet"))
    return str(folder)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
