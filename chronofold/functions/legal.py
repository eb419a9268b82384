"""Scalars of legal texts and questions: numbers, dates, quotes, categories, document types."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import by_pieces, squeeze

# Type codes of document numbers.
TYPE_CODES = ["TT", "TTLT", "NĐ", "ND", "QĐ", "QD", "NQ", "QH", "CT", "PL", "UBTVQH", "L", "TB", "VBHN"]
# Forms of document numbers.
NUMBER_FORMS = [
    r"[0-9]{1,4}/[0-9]{4}/[A-ZĐ]+[0-9]*(?:-[A-ZĐ0-9]+)?",
    r"[A-ZĐ]{2,4}-[A-ZĐ]{2,4}-[0-9]+/[A-ZĐ0-9]+",
    r"[A-ZĐ]{2,4}-[0-9]+/[0-9]{4}",
    r"[0-9]{1,5}/(?:QĐ|QD|NQ|CT|TB)-[A-ZĐ0-9]{1,12}",
]
# Title openings and number parts that tell a document's type.
TYPE_BY_TITLE = [("VĂN BẢN HỢP NHẤT", "vbhn"), ("BỘ LUẬT", "luat"), ("LUẬT", "luat"), ("NGHỊ QUYẾT", "nghi_quyet"), ("MẪU", "bieu_mau"), ("CÔNG VĂN", "cong_van")]
TYPE_BY_NUMBER = [
    ("TT-", "thong_tu"), ("TTLT", "thong_tu"), ("NĐ-CP", "nghi_dinh"), ("ND-CP", "nghi_dinh"), ("NQ-HĐTP", "nghi_quyet"),
    ("NQ-", "nghi_quyet"), ("QĐ-", "quyet_dinh"), ("QD-", "quyet_dinh"), ("QH", "luat"), ("/SHB", "noi_bo"),
]
# Loan terms.
CATEGORIES = [("ngắn hạn", "ngan_han"), ("trung hạn", "trung_han"), ("dài hạn", "dai_han")]
# Phrases about time, in text without accents.
PENDING = r"sap\s+toi|sap\s+co\s+hieu\s+luc|tu\s+thang\s+sau|thoi\s+gian\s+toi|chuan\s+bi\s+co\s+hieu\s+luc|sap\s+thay\s+doi|se\s+thay\s+doi|sap\s+ban\s+hanh"
CURRENT = r"hien\s+nay|hien\s+tai|bay\s+gio|hom\s+nay|dang\s+ap\s+dung|moi\s+nhat"

_LONG = r"ngày\s+([0-9]{1,2})\s+tháng\s+([0-9]{1,2})\s+năm\s+([0-9]{4})"
_SLASH = r"ngày\s+([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
_LIMIT = r"(?iu)(?:tối\s*đa|không\s*vượt\s*quá)[^0-9%]{0,80}?([0-9]+(?:[.,][0-9]+)?)\s*%\s*/\s*năm"


@F.arrow_udf(StringType())
def nfc(c: pa.Array) -> pa.Array:
    """Composed form of a text; Spark has no function for it."""
    return by_pieces(lambda s: None if s is None else unicodedata.normalize("NFC", s), pa.string(), c)


@F.arrow_udf(StringType())
def _bare(c: pa.Array) -> pa.Array:
    return by_pieces(lambda s: None if s is None else "".join(x for x in unicodedata.normalize("NFD", s) if not unicodedata.combining(x)), pa.string(), c)


def strip_diacritics(c: Column) -> Column:
    """đ to d, and no combining marks."""
    return _bare(F.translate(c, "đĐ", "dD"))


def normalize_text(c: Column) -> Column:
    """Composed, white space squeezed; null to ''."""
    return squeeze(nfc(c))


def glue_numbers(c: Column) -> Column:
    """Document numbers without stray blanks; only known type codes, so that dates stay."""
    head = r"([0-9]{1,4})\s*/\s*([0-9]{4})\s*/\s*((?=%s)[A-ZĐ]{1,8}[0-9]*)" % "|".join(TYPE_CODES)
    return F.regexp_replace(F.regexp_replace(c, head + r"\s*-\s*([A-ZĐ][A-ZĐ0-9]{0,11})", "$1/$2/$3-$4"), head, "$1/$2/$3")


def loose_numbers(c: Column) -> Column:
    """All document numbers of a text, canonical, blanks allowed inside."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_/])[0-9]{1,4}\s*/\s*[0-9]{4}\s*/\s*[A-ZĐa-zđ]{1,8}[0-9]{0,3}(?:\s*-\s*[A-ZĐa-zđ][A-ZĐa-zđ0-9]{0,14})*(?![\p{L}\p{N}_/])"), F.lit(0))
    return F.transform(found, lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))


def first_number(c: Column) -> Column:
    """The first document number in any of four forms; null for none."""
    return F.nullif(F.regexp_extract(c, "|".join(NUMBER_FORMS), 0), F.lit(""))


def _date(c: Column, pattern: str, order: tuple[int, int, int] = (1, 2, 3)) -> Column:
    d, m, y = (F.regexp_extract(c, pattern, k) for k in order)
    return F.when(c.rlike(pattern), F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))))


def parse_date(c: Column) -> Column:
    """The first date in words, else the first with slashes; a date that is none is null."""
    return F.when(c.rlike(_LONG), _date(c, _LONG)).otherwise(_date(c, _SLASH))


def unquote(c: Column) -> Column:
    """Without one pair of outer quotes and the full stop after it."""
    s = F.trim(c)
    s = F.regexp_replace(s, '([”"])\\.$', "$1")
    whole = (F.length(s) > 1) & ((s.startswith("“") & s.endswith("”")) | (s.startswith('"') & s.endswith('"')))
    return F.trim(F.when(whole, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s))


def rates(c: Column) -> Column:
    """Upper limits of a yearly rate, as numbers."""
    return F.transform(F.regexp_extract_all(c, F.lit(_LIMIT), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def category(c: Column, at: Column) -> Column:
    """The loan term named from 120 characters before a place (from 0) to 40 after it."""
    start = F.greatest(at - 120, F.lit(0))
    near = F.lower(F.substring(c, start + 1, at + 40 - start))
    out = F.when(F.lit(False), F.lit(""))
    for words, name in CATEGORIES:
        out = out.when(near.contains(words), name)
    return out.otherwise("chung")


def doc_type(number: Column, title: Column) -> Column:
    """Type by the title's opening, else by the number."""
    up = F.upper(F.coalesce(title, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for start, name in TYPE_BY_TITLE:
        out = out.when(up.startswith(start), name)
    for part, name in TYPE_BY_NUMBER:
        out = out.when(number.contains(part), name)
    return out.otherwise("thong_tu")


def issuer(number: Column, kind: Column) -> Column:
    """Issuer by the number: the house, parliament, government, court, else what follows the last hyphen."""
    has = lambda *xs: F.greatest(*[number.contains(x) for x in xs], F.lit(False))
    tail = F.substring_index(number, "-", -1)
    return (
        F.when(has("/SHB"), "SHB").when((kind == "luat") | has("QH"), "QH").when(has("NĐ-CP", "ND-CP"), "CP").when(has("HĐTP", "HDTP"), "HDTP")
        .when(has("-") & tail.rlike(r"^\p{L}+$"), tail).otherwise("NHNN")
    )


def norm_line(c: Column) -> Column:
    """A line of a page: composed, no zero-width spaces, white space squeezed."""
    return squeeze(F.translate(nfc(c), " ​", " "))


def chunks(c: Column, size: int = 24) -> Column:
    """Pieces of whole words, each closed at `size` characters, for streaming."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    step = lambda a, w: F.when(F.length(F.concat(a.open, w)) + 1 >= size, F.struct(F.concat(a.done, F.array(F.concat(a.open, w, F.lit(" ")))).alias("done"), F.lit("").alias("open"))).otherwise(F.struct(a.done.alias("done"), F.concat(a.open, w, F.lit(" ")).alias("open")))
    return F.aggregate(F.split(c, " "), empty, step, lambda a: F.when(a.open == "", a.done).otherwise(F.concat(a.done, F.array(F.regexp_replace(a.open, " $", "")))))


def as_of(plain: Column, today: Column, session: Column | None = None) -> Column:
    """struct(as_of, mode) of a question without accents in lower case: words for the future, a date (in words,
    with slashes, with hyphens), a month's or year's last day, words for now, the session's date, today."""
    now = today if session is None else F.coalesce(session, today)
    day = None
    for p in (r"ngay\s+([0-9]{1,2})\s+thang\s+([0-9]{1,2})\s+nam\s+([0-9]{4})", r"([0-9]{1,2})\s*/\s*([0-9]{1,2})\s*/\s*([0-9]{4})", r"([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})"):
        day = _date(plain, p) if day is None else F.coalesce(day, _date(plain, p))
    month = r"thang\s+([0-9]{1,2})\s*(?:/|nam\s+)([0-9]{4})"
    in_month = F.when(plain.rlike(month), F.last_day(F.try_to_date(F.concat_ws("-", F.regexp_extract(plain, month, 2), F.lpad(F.regexp_extract(plain, month, 1), 2, "0"), F.lit("01")))))
    year = r"nam\s+([0-9]{4})"
    in_year = F.when(plain.rlike(year), F.try_to_date(F.concat(F.regexp_extract(plain, year, 1), F.lit("-12-31"))))
    mode = lambda d: F.when(d == today, "current").otherwise("point_in_time")
    pick = lambda d, m: F.struct(d.alias("as_of"), m.alias("mode"))
    return (
        F.when(plain.rlike(PENDING), pick(now, F.lit("pending"))).when(day.isNotNull(), pick(day, mode(day)))
        .when(in_month.isNotNull(), pick(in_month, F.lit("point_in_time"))).when(in_year.isNotNull(), pick(in_year, F.lit("point_in_time")))
        .otherwise(pick(now, mode(now)))
    )


# Phrases about a contract, in text without accents.
_DAY = r"(?:ngay\s+)?([0-9]{1,2})\s*/\s*([0-9]{1,2})\s*/\s*([0-9]{4})"
SIGNED = (r"ky(?:\s+ket)?\s+truoc\s+" + _DAY, r"ky(?:\s+ket)?\s+" + _DAY, r"ky(?:\s+ket)?\s+(?:trong\s+)?thang\s+([0-9]{1,2})\s*(?:/|nam\s+)([0-9]{4})", r"ky(?:\s+ket)?\s+(?:trong\s+)?nam\s+([0-9]{4})")
UNAMENDED = r"(?:chua|khong)\s+(?:duoc\s+)?sua\s+doi(?:[,\s]+bo\s+sung)?(?:\s+(?:gi\s+)?(?:tu|sau)\s+" + _DAY + ")?"
PERSON = r"khach\s+hang\s+(?:la\s+)?ca\s+nhan|ca\s+nhan\s+vay"
COMPANY = r"khach\s+hang\s+(?:la\s+)?(?:phap\s+nhan|doanh\s+nghiep|to\s+chuc)|doanh\s+nghiep\s+vay"


def signed_before(plain: Column) -> Column:
    """Upper bound of a signing date: before a date, that date's next day, the next month's or year's first day."""
    before, on, month, year = SIGNED
    first = F.try_to_date(F.concat_ws("-", F.regexp_extract(plain, month, 2), F.lpad(F.regexp_extract(plain, month, 1), 2, "0"), F.lit("01")))
    return (
        F.when(plain.rlike(before), _date(plain, before)).when(plain.rlike(on), F.date_add(_date(plain, on), 1))
        .when(plain.rlike(month), F.add_months(first, 1)).when(plain.rlike(year), F.try_to_date(F.concat((F.regexp_extract(plain, year, 1).try_cast("int") + 1).cast("string"), F.lit("-01-01"))))
    )


def cohort(plain: Column) -> Column:
    """struct(contract_signed_before, not_amended_on_or_after, entity_class) that a question states; "not amended" without
    a date holds from 1900 on."""
    since = F.when(F.regexp_extract(plain, UNAMENDED, 1) == "", F.lit("1900-01-01").cast("date")).otherwise(_date(plain, UNAMENDED))
    return F.struct(
        signed_before(plain).alias("contract_signed_before"), F.when(plain.rlike(UNAMENDED), since).alias("not_amended_on_or_after"),
        F.when(plain.rlike(PERSON), "ca_nhan").when(plain.rlike(COMPANY), "phap_nhan").alias("entity_class"),
    )


def without_cohort(plain: Column) -> Column:
    """A question without what it says of the contract's dates: the first signing phrase there is, then the one about
    amendments, wherever they are repeated."""
    gone = lambda c, form: F.replace(c, F.regexp_extract(c, form, 0), F.lit(" "))
    signed = F.lit(None).cast("string")
    for form in reversed(SIGNED):
        signed = F.when(plain.rlike(form), gone(plain, form)).otherwise(F.coalesce(signed, plain))
    return F.when(signed.rlike(UNAMENDED), gone(signed, UNAMENDED)).otherwise(signed)
