"""Text scalars as column expressions; Unicode classes are always written out."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"
# Address units and their printed names.
UNITS = {"dieu": "Điều", "khoan": "khoản", "diem": "điểm", "tiet": "tiết", "phuluc": "Phụ lục"}
# The Vietnamese alphabet of point labels.
LETTERS = "aăâbcdđeêghiklmnoôơpqrstuưvxy"

# Tags that show a page, and tags that end a line.
TAGGED = r"(?i)<(p|div|html|body|table|span|br)\b"
BLOCKS = r"(?i)</?(p|div|tr|table|h[1-6]|li|ul|ol|br)[^>]*>"


def squeeze(c: Column) -> Column:
    """White space runs to one space, trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def collapse_spaces(c: Column) -> Column:
    """Runs of blanks to one, no blanks at line ends; line breaks stay."""
    return F.regexp_replace(F.regexp_replace(c, "[\t    ]+", " "), " (?=\n)| $", "")


#: Bytes of rows that are Python objects at once.
PIECE = 1 << 22


def by_pieces(f: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f of each row of the columns, null for None. Only some rows at a time are Python objects, which take several times
    the room that they have in a batch; a row is never cut."""
    texts = [c for c in columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
    size = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype("int64") for c in texts), 0)
    size = size + sum(c.nbytes // max(len(c), 1) for c in columns if not any(c is t for t in texts))
    out, lo, held = [pa.array([], kind)], 0, 0
    for hi, n in enumerate(size.tolist()):
        if hi > lo and held + n > PIECE:
            out.append(pa.array([f(*x) for x in zip(*[c.slice(lo, hi - lo).to_pylist() for c in columns])], kind))
            lo, held = hi, 0
        held += n
    out.append(pa.array([f(*x) for x in zip(*[c.slice(lo).to_pylist() for c in columns])], kind))
    return pa.concat_arrays(out)


@F.arrow_udf(StringType())
def unescaped(texts: pa.Array) -> pa.Array:
    """Character references decoded in one pass; Spark has no function for them."""
    return by_pieces(lambda s: None if s is None else unescape(s), pa.string(), texts)


def strip_html(c: Column, references: tuple[tuple[str, str], ...] | None = None) -> Column:
    """Block tags to line breaks, other tags to spaces, then character references decoded, in texts that hold a tag of
    pages at all; other texts stay as they are. references: only these, as (pattern, character) in their order; all of
    HTML, with those that need no semicolon, where there is no such list."""
    page = F.contains(c, F.lit("<")) & F.contains(c, F.lit(">")) & c.rlike(TAGGED)
    plain = F.regexp_replace(F.regexp_replace(c, BLOCKS, "\n"), "<[^>]+>", " ")
    if references is None:
        plain = unescaped(plain)
    for printed, character in references or ():
        plain = F.regexp_replace(plain, printed, character)
    return F.when(page, plain).otherwise(c)


def tokens(c: Column) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def digit_runs(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))


def quotes(c: Column, least: int = 10) -> Column:
    """Quoted strings of some length, in three quote styles."""
    found = [F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in ('"([^"]{%d,})"' % least, "“([^”]{%d,})”" % least, "«([^»]{%d,})»" % least)]
    return F.concat(*found)


def canonical_doc_number(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def doc_numbers(c: Column) -> Column:
    """Document numbers such as 39/2016/TT-NHNN."""
    return F.regexp_extract_all(c, F.lit(r"[0-9]+/[0-9]{4}/[A-ZĐ]+(?:-[A-ZĐ]+)*"), F.lit(0))


def path_prefixes(c: Column) -> Column:
    """All prefixes of a path, shortest first."""
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def surface_of_path(c: Column) -> Column:
    """dieu:8/khoan:2 as a printed address, innermost unit first."""
    names = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.array_join(F.reverse(F.transform(F.split(c, "/"), lambda p: F.concat_ws(" ", F.coalesce(names[F.substring_index(p, ":", 1)], F.substring_index(p, ":", 1)), F.substring_index(p, ":", -1)))), ", ")


def cut_words(c: Column, limit: int) -> Column:
    """Squeezed text cut at a word within a limit, with an ellipsis where something is missing."""
    s = squeeze(c)
    head = F.regexp_extract(s, r"^(.{0,%d})(?:\s|$)" % limit, 1)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(head, F.lit("…")))


def token_count(c: Column) -> Column:
    """White-space words."""
    s = squeeze(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def rate(c: Column) -> Column:
    """The first percentage, decimal comma or point, as a number."""
    return F.replace(F.regexp_extract(c, r"([0-9]+(?:[.,][0-9]+)?) ?%", 1), F.lit(","), F.lit(".")).try_cast("double")


def next_letter(c: Column) -> Column:
    """Successor of a label's first letter in the alphabet of point labels; null after the last."""
    at = F.instr(F.lit(LETTERS), F.substring(c, 1, 1))
    return F.when((at > 0) & (at < len(LETTERS)), F.substring(F.lit(LETTERS), at + 1, 1))
