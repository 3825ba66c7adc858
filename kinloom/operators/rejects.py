"""Dump lines loaded as statements, and those that fail with the reason: a CSV reader for the structure, vectors for the cells.

A batch of lines is turned into delimited rows (terms end at DELIMITER, which an expression finds), which pyarrow's CSV
reader loads as strings; rows with a wrong number of fields come back through its invalid-row handler. The loaded columns
are then matched against the grammar of their place, and literals of XSD types cast, as vectors; the first failing cell
gives the reason. Nothing is shuffled or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.statements import FIELDS, LEXICAL, XSD, parse_line

DELIMITER = "\x1f"
# Stands for a delimiter that the line itself holds.
STAND_IN = ""
UCHAR = r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})"
IRI = r'<[A-Za-z][A-Za-z0-9+.\-]*:(?:[^\x00-\x20<>"{}|^`\\]|' + UCHAR + ")*>"
_U = (r"A-Za-z0-9_:\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}\x{200D}\x{2070}-\x{218F}"
      r"\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}")
_C = _U + r"\x{B7}\x{300}-\x{36F}\x{203F}\x{2040}\-"
BLANK = f"_:[{_U}](?:[{_C}.]*[{_C}])?"
TEXT = r'"(?:[^"\\\r\n]|\\[tbnrf"\'\\]|' + UCHAR + r')*"'
LITERAL = TEXT + r"(?:\^\^" + IRI + r"|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?"
# A term in the rough, and the white space after it.
TERM = r'(<[^<>]*>|"(?:[^"\\]|\\.)*"(?:\^\^<[^<>]*>|@[A-Za-z0-9\-]*)?|' + BLANK + r")[ \t]*"
PLACES = {"s": (f"{IRI}|{BLANK}", "not an IRI or blank node"), "p": (IRI, "not an IRI"), "o": (f"{IRI}|{BLANK}|{LITERAL}", "not a term"),
          "g": (f"(?:{IRI}|{BLANK})?", "not an IRI or blank node"), "dot": r"\.[ \t]*[\r\n]*"}


def _whole(x: pa.Array, pattern: str) -> pa.Array:
    return pc.match_substring_regex(x, rf"(?s)\A(?:{pattern})\z")


def _rows(lines: pa.Array) -> pa.Array:
    """Each line as number, subject, predicate, object, graph and the end, with the comment after the dot left out."""
    x = pc.replace_substring(lines, DELIMITER, STAND_IN)
    x = pc.replace_substring_regex(x, r"[\r\n]+\z", "")
    x = pc.replace_substring_regex(x, r"[\r\n]", " ")
    x = pc.replace_substring_regex(x, TERM, r"\1" + DELIMITER)
    x = pc.replace_substring_regex(x, rf"(?s){DELIMITER}\.[ \t]*#.*\z", f"{DELIMITER}.")
    x = pc.replace_substring_regex(x, r"\A[ \t]+", "")
    triple = pc.equal(pc.count_substring(x, DELIMITER), 3)
    x = pc.if_else(triple, pc.replace_substring_regex(x, rf"(?s){DELIMITER}([^{DELIMITER}]*)\z", rf"{DELIMITER}{DELIMITER}\1"), x)
    return pc.binary_join_element_wise(pc.cast(pa.array(range(len(x))), pa.string()), x, DELIMITER)


def _typed(o: pa.Array, reason: pa.Array) -> pa.Array:
    """Adds the reason of literals outside their XSD type."""
    part = pc.extract_regex(o, r'(?s)\A"(?P<text>.*)"\^\^<' + XSD.replace(".", r"\.") + r"(?P<kind>[A-Za-z]+)>\z")
    text, kind = pc.struct_field(part, "text"), pc.struct_field(part, "kind")
    for name, pattern in LEXICAL.items():
        own = pc.fill_null(pc.equal(kind, name), False)
        fine = pc.fill_null(_whole(text, pattern.pattern), False)
        if name.startswith("date"):
            day = pc.extract_regex(text, r"\A-?(?P<y>[0-9]{4,})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})")
            # the last four digits of a year decide whether it is a leap year
            y, m, d = (pc.fill_null(pc.cast(pc.utf8_slice_codeunits(pc.struct_field(day, f), -4), pa.int32()), 1) for f in "ymd")
            mod = lambda n: pc.equal(pc.subtract(y, pc.multiply(pc.divide(y, n), n)), 0)
            leap = pc.or_(pc.and_(mod(4), pc.invert(mod(100))), mod(400))
            short = pc.is_in(m, pa.array([4, 6, 9, 11], pa.int32()))
            last = pc.if_else(pc.equal(m, 2), pc.if_else(leap, 29, 28), pc.if_else(short, 30, 31))
            fine = pc.and_(fine, pc.less_equal(d, last))
        reason = pc.if_else(pc.and_(own, pc.invert(fine)), f"o: not a {name}", reason)
    return reason


def _loaded(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, lines = batch.column(0), batch.column(1)
    bare = pc.utf8_trim_whitespace(lines)
    kept = pc.fill_null(pc.and_(pc.not_equal(bare, ""), pc.invert(pc.starts_with(bare, "#"))), False)
    ids, lines = ids.filter(kept), lines.filter(kept)
    n = len(lines)
    broken = pc.match_substring_regex(pc.replace_substring_regex(lines, r"[\r\n]+\z", ""), r"[\r\n]").to_pylist()
    cells = {c: [None] * n for c in "spog"}
    reasons: list[str | None] = [None] * n
    if n:
        def reject(row: csv.InvalidRow) -> str:
            reasons[int(row.text.split(DELIMITER, 1)[0])] = f"line: {row.actual_columns - 2} terms"
            return "skip"

        names = ["at", "s", "p", "o", "g", "dot"]
        table = csv.read_csv(
            pa.BufferReader("\n".join(_rows(lines).to_pylist()).encode()), csv.ReadOptions(column_names=names, use_threads=False, block_size=1 << 28),
            csv.ParseOptions(delimiter=DELIMITER, quote_char=False, escape_char=False, invalid_row_handler=reject),
            csv.ConvertOptions(column_types={c: pa.string() for c in names}, strings_can_be_null=False))
        col = {c: pc.replace_substring(pc.cast(table.column(c), pa.string()), STAND_IN, DELIMITER).combine_chunks() if c != "at" else table.column(c).combine_chunks() for c in names}
        reason = pa.nulls(len(table), pa.string())
        for c, (pattern, why) in [(c, PLACES[c]) for c in "gops"]:
            reason = pc.if_else(_whole(col[c], pattern), reason, f"{c}: {why}")
        reason = pc.if_else(_whole(col["dot"], PLACES["dot"]), reason, "line: no final dot")
        reason = _typed(col["o"], reason)
        # escapes inside a typed literal are undone before its type is checked, one by one as they are rare
        escaped = pc.and_(pc.match_substring(col["o"], "\\"), pc.match_substring(col["o"], '"^^<'))
        for i, s, p, o, g, why, hard in zip(*(col[c].to_pylist() for c in ("at", "s", "p", "o", "g")), reason.to_pylist(), escaped.to_pylist()):
            i = int(i)
            if broken[i]:
                why = "line: a line break"
            elif hard and (why is None or why.startswith("o: not a ")):
                why = parse_line(lines[i].as_py())[4]
                why = why and f"o: {why}"
            reasons[i] = why
            if why is None:
                cells["s"][i], cells["p"][i], cells["o"][i], cells["g"][i] = s, p, o, g or None
    return pa.RecordBatch.from_arrays([ids, *(pa.array(cells[c], pa.string()) for c in "spog"), pa.array(reasons, pa.string())], names=[batch.schema.names[0], *FIELDS])


def load_statements(lines: DataFrame, row_id: str, line: str) -> DataFrame:
    """(row_id, s, p, o, g, reason) for each row that is neither blank nor a comment: its terms, or why it has none.

    A reason names the failing cell ("o: not a date") or the line ("line: 2 terms"). Null lines are passed over, rows
    come out as often as they go in, null ids stay null, an empty table gives no rows, other columns are ignored.
    """
    kind = dict(lines.dtypes)[row_id]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _loaded(batch)

    rows = lines.select(F.col(row_id), F.col(line).cast("string"))
    return rows.mapInArrow(load, f"{row_id} {kind}, " + ", ".join(f"{c} string" for c in FIELDS))
