"""Files of nested records: YAML's block style and JSON, a row per record.

A file is parsed whole in one task (such files describe one site or list some thousands), files in parallel; the parser turns
each record to JSON, and ``from_json`` with the caller's schema picks typed fields from any depth.

Of YAML it reads what configuration files hold: nested mappings and lists by indentation, lists of mappings, flow lists and
mappings on one line if they are JSON or plain words, quoted and plain scalars, comments, block text (``|`` and ``>``), several
documents. Anchors and tags are kept as text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.session import ship

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[{"'-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+|$)(.*)$""")
_ITEM = re.compile(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,"']|["'])+""")
_NUMBER = re.compile(r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$")


def scalar(text: str) -> object:
    """A plain, quoted or flow value."""
    text = text.strip()
    if text[:1] == '"':
        try:
            return json.loads(text)
        except ValueError:
            return text.strip('"')
    if text[:1] == "'":
        return text[1:-1].replace("''", "'") if text.endswith("'") and len(text) > 1 else text
    if text[:1] in "[{" and text:
        try:
            return json.loads(text)
        except ValueError:
            inner = [x.strip() for x in _ITEM.findall(text[1:-1]) if x.strip()]
            return [scalar(x) for x in inner] if text[0] == "[" else {k.strip(): scalar(v) for k, _, v in (x.partition(":") for x in inner)}
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if _NUMBER.match(text):
        return float(text) if re.search(r"[.eE]", text) else int(text)
    return text


def _bare(line: str) -> str:
    """The line without a comment; a # within quotes or a word is none."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (c == '"' and line[i - 1] == "\\") else quote
        elif c in "\"'" and (not line[:i].strip() or line[i - 1] in " [{,"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


class _Lines:
    def __init__(self, text: str):
        self.raw = text.split("\n")
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        """Indent and content of the next line that has any."""
        while self.at < len(self.raw):
            line = _bare(self.raw[self.at])
            if line.strip():
                return len(line) - len(line.lstrip(" ")), line.strip()
            self.at += 1
        return None

    def block(self, indent: int, folded: bool) -> str:
        """Block text: all lines indented deeper, as they are or joined."""
        out = []
        while self.at < len(self.raw):
            line = self.raw[self.at]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                break
            out.append(line)
            self.at += 1
        depth = min((len(x) - len(x.lstrip(" ")) for x in out if x.strip()), default=0)
        cut = [x[depth:].rstrip() for x in out]
        return (" " if folded else "\n").join(cut).strip() + ("" if folded else "\n")


def _value(lines: _Lines, text: str, indent: int, in_list: bool = False) -> object:
    """What follows a key or a dash: text of its own, block text, or what is indented deeper."""
    if text[:1] in ("|", ">"):
        return lines.block(indent, text[0] == ">")
    if text:
        return scalar(text)
    ahead = lines.peek()
    if ahead and (ahead[0] > indent or not in_list and ahead[0] == indent and ahead[1].startswith("-")):
        return _node(lines, ahead[0])
    return None


def _node(lines: _Lines, indent: int) -> object:
    """The mapping, list or scalar that begins at this indent."""
    ahead = lines.peek()
    if ahead is None:
        return None
    if ahead[1] == "-" or ahead[1].startswith("- "):
        items = []
        while (ahead := lines.peek()) and ahead[0] == indent and (ahead[1] == "-" or ahead[1].startswith("- ")):
            rest = ahead[1][1:].strip()
            if _KEY.match(rest) and rest[:1] not in "[{":
                inner = indent + len(ahead[1]) - len(rest)
                lines.raw[lines.at] = " " * inner + rest  # a mapping whose first key stands behind the dash
                items.append(_node(lines, inner))
            else:
                lines.at += 1
                items.append(_value(lines, rest, indent, in_list=True))
        return items
    if not _KEY.match(ahead[1]):
        lines.at += 1
        return scalar(ahead[1])
    out = {}
    while (ahead := lines.peek()) and ahead[0] == indent and (m := _KEY.match(ahead[1])):
        lines.at += 1
        key = scalar(m[1]) if m[1][:1] in "\"'" else m[1]
        out[str(key)] = _value(lines, m[2].strip(), indent)
    return out


def parse(text: str) -> list[object]:
    """Records of a file: of a JSON list or of lines of JSON each element, else each YAML document (a list's elements)."""
    start = text.lstrip("\ufeff \t\r\n")
    if start[:1] in ("{", "["):
        try:
            made = json.loads(start)
            return made if isinstance(made, list) else [made]
        except ValueError:
            pass
        try:
            return [json.loads(x) for x in start.split("\n") if x.strip()]
        except ValueError:
            pass
    out = []
    for document in re.split(r"(?m)^---(?:[ \t].*)?$", text.replace("\r\n", "\n").lstrip("\ufeff")):
        lines = _Lines(document)
        ahead = lines.peek()
        made = _node(lines, ahead[0]) if ahead else None
        out += made if isinstance(made, list) else [made] if made is not None else []
    return out


def read_records(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """path and the fields of ``schema``, a row per record. Records that are no mapping, and fields of another type, give nulls."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(path, json.dumps(r)) for path, text in zip(*(c.to_pylist() for c in batch.columns)) for r in parse(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["path", "record"])

    rows = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value").mapInArrow(run, "path string, record string")
    return rows.withColumn("record", F.from_json("record", schema)).select("path", "record.*")
