"""Text, key and parsing functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- canonical text -------------------------------------------------------


def fixed_text(column: Column) -> Column:
    """A decimal as a quoted fixed-point number."""
    return F.concat(F.lit('"'), column.cast("string"), F.lit('"'))


def json_string(column: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes, controls and all else escaped."""
    def unit(code):
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escape(c):
        code = F.ascii(c)
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
        return (
            F.when(c == '"', F.lit('\\"'))
            .when(c == "\\", F.lit("\\\\"))
            .when(c == "\n", F.lit("\\n"))
            .when(c == "\r", F.lit("\\r"))
            .when(c == "\t", F.lit("\\t"))
            .when(c == "\b", F.lit("\\b"))
            .when(c == "\f", F.lit("\\f"))
            .when((code >= 32) & (code <= 127), c)
            .when(code > 0xFFFF, F.concat(unit(high), unit(low)))
            .otherwise(unit(code))
        )

    plain = ~column.rlike(r'[^\x20-\x7f]|["\\]')
    escaped = F.array_join(F.transform(F.split(column, ""), escape), "")
    return F.concat(F.lit('"'), F.when(plain, column).otherwise(escaped), F.lit('"'))


def json_object(fields: dict[str, Column]) -> Column:
    """An object from ready JSON texts, keys in alphabetical order."""
    parts = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + f'"{key}":'), fields[key]]
    return F.concat(*parts, F.lit("}"))


# --- identity -------------------------------------------------------------


def content_tag(content: Column, digits: int = 16) -> Column:
    """Version tag of a mapping or ruleset: ``sha256:`` and the first hex digits."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(content, 256), 1, digits))


def development_key(sha256: Column) -> Column:
    """Business key of the development a workbook describes."""
    return F.concat(F.lit("DEV-"), F.upper(F.substring(sha256, 1, 10)))


def entity_id(*parts) -> Column:
    """Deterministic technical id from a business key; a NULL part counts as empty text."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def _digest(column: Column) -> Column:
    return column.rlike(r"\A[0-9a-f]{64}\z")


def packed(column: Column) -> Column:
    """A text as bytes, told apart as the text is: digests, as ``entity_id`` gives, in half their length, others as they stand."""
    mark = lambda n: F.lit(bytearray([n]))
    return F.when(_digest(column), F.concat(mark(1), F.unhex(column))).otherwise(F.concat(mark(0), column.cast("binary")))


def unpacked(column: Column) -> Column:
    """The text that ``packed`` was given."""
    rest = F.substring(column, 2, 2**31 - 1)
    return F.when(F.substring(column, 1, 1) == F.lit(bytearray([1])), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def least_id(column: Column) -> Column:
    """``min`` of an id. Digests are shuffled in half their length; their bytes have the order of their digits."""
    digest = _digest(column)
    return F.least(F.min(F.when(~digest, column)), F.lower(F.hex(F.min(F.when(digest, F.unhex(column))))))


# --- values ---------------------------------------------------------------


def blank(column: Column) -> Column:
    """NULL, empty or only spaces."""
    return F.coalesce(F.trim(column) == "", F.lit(True))


def effective_value(raw: str = "raw_value", cached: str = "cached_value") -> Column:
    """A formula keeps its value in the cache, a plain cell in the raw text."""
    return F.coalesce(F.col(raw), F.col(cached))


def number(column: Column, kind: str = "decimal(38,18)") -> Column:
    """Text as a decimal when it is one, else NULL. Suffixes, nan and inf are not numbers."""
    return column.try_cast(kind)


def numeric_or_null(column: Column) -> Column:
    """The text itself when it parses as a number."""
    return F.when(number(column).isNotNull(), column)


def zero_if_blank(column: Column) -> Column:
    """Blank gives 0, a number gives itself, other text gives NULL."""
    return F.when(column.isNull() | (column == ""), F.lit("0")).otherwise(numeric_or_null(column))


# Texts that read as true.
TRUE_WORDS = ["1", "true", "t", "sim"]


def typed_value(text: Column, kind: Column) -> Column:
    """One parameter text as a struct with exactly one filled column."""
    kind = F.when(kind.isin("NUMERIC", "BOOLEAN", "DATE"), kind).otherwise(F.lit("TEXT"))
    return F.struct(
        kind.alias("value_type"),
        F.when(kind == "NUMERIC", text.try_cast("decimal(18,6)")).alias("numeric_value"),
        F.when(kind == "TEXT", text).alias("text_value"),
        F.when(kind == "BOOLEAN", F.lower(F.trim(text)).isin(TRUE_WORDS)).alias("boolean_value"),
        F.when(kind == "DATE", text.try_cast("date")).alias("date_value"),
    )


def serial_date(number_: Column) -> Column:
    """Spreadsheet serial day to a date; the time of day is dropped."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number_).cast("int"))


# --- names and keys -------------------------------------------------------


def column_index(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    return F.aggregate(
        F.split(letters, ""), F.lit(0), lambda acc, c: (acc * 26 + F.ascii(c) - 64).cast("int")
    )


def cell_letters(ref: Column) -> Column:
    return F.regexp_extract(ref, "^([A-Z]+)([0-9]+)$", 1)


def cell_row(ref: Column) -> Column:
    return F.regexp_extract(ref, "^([A-Z]+)([0-9]+)$", 2).try_cast("int")


def normalize_name(column: Column) -> Column:
    """Lower case letters and digits only; accented letters are dropped, not folded."""
    return F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), "[^a-z0-9]", "")


def key_component(column: Column) -> Column:
    """Key text of a value: 3.0 gives 3, 2.50 stays 2.50, other text stays itself."""
    value = number(column)
    return F.when(value.isNull(), column).when(
        value == F.floor(value), F.floor(value).cast("decimal(38,0)").cast("string")
    ).otherwise(column)


def composite_key(columns: list[Column], separator: str) -> Column:
    """Normalised parts joined by a separator; any missing part gives NULL."""
    parts = []
    for i, c in enumerate(columns):
        parts += ([F.lit(separator)] if i else []) + [key_component(c)]
    return F.concat(*parts)


def magnitude_prefix(column: Column, threshold, below: int, at_or_above: int) -> Column:
    """The first digits of the whole part; how many depends on the signed value."""
    value = number(column)
    digits = F.abs(_truncate(value)).cast("string")
    size = F.when(value < F.lit(str(threshold)).cast("decimal(38,18)"), F.lit(below)).otherwise(F.lit(at_or_above))
    return F.when(size > 0, F.substring(digits, F.lit(1), size))


def _truncate(value: Column) -> Column:
    """Whole part, towards zero."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("decimal(38,0)")


# --- personal data --------------------------------------------------------

# Patterns of personal data and hints in column headers.
PERSONAL_PATTERNS = {
    "cpf": r"^\d{3}\.?\d{3}\.?\d{3}-?\d{2}$",
    "telefone": r"^(\+?55)?\s*\(?\d{2}\)?\s*\d{4,5}-?\d{4}$",
    "email": r"^[^@\s]+@[^@\s]+\.[a-zA-Z]{2,}$",
}
PERSONAL_HEADERS = [
    "cpf", "cnpj", "telefone", "celular", "email", "e-mail", "nome", "cliente", "comprador", "rg", "identidade",
    "endereco", "endereço",
]


def personal_value(column: Column) -> Column:
    text = F.trim(column)
    hit = F.lit(False)
    for pattern in PERSONAL_PATTERNS.values():
        hit = hit | text.rlike(pattern)
    return F.coalesce(hit, F.lit(False))


def personal_header(column: Column) -> Column:
    hit = F.lit(False)
    for hint in PERSONAL_HEADERS:
        hit = hit | F.contains(F.lower(column), F.lit(hint))
    return F.coalesce(hit, F.lit(False))


# Eight words of a hex digest, added up as whole numbers: a digest of a set of rows.
DIGEST_WORDS = [f"word{i}" for i in range(8)]


def digest_sums(digest: Column) -> list[Column]:
    """Sums of the 32-bit words of SHA-256 digests, named as DIGEST_WORDS; exact for two billion rows in a group."""
    return [F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")).alias(w) for i, w in enumerate(DIGEST_WORDS)]
