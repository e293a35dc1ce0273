"""Column expressions over text. No row-at-a-time Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

# Fixed values.
STOP_WORDS = (
    "и в во на к ко с со у о об от до по из за как какой какая какие какое для про при это что чего где когда "
    "нужно нужен нужна нужны требуется можно надо есть или чем почему который которого чтобы этого этой если "
    "семейство семейства revit the and with what how подходят используют моделирования"
).split()
ENDINGS = (
    "иями ями ами ого ему ому ыми ими ая яя ое ее ые ие ую юю ою ею ым им ых их ой ый ий ей ов ев ам ям ах ях "
    "ом ем ы и а я у ю е"
).split()
WHITE = " \t\n\r\x0b\x0c\x85\xa0"
NEGATIONS = ("не", "нельзя", "без")
TOKEN_RUN = r"[\p{L}\p{N}_№.+\-]+"
IDENTIFIER = r"[\p{L}\p{N}][\p{L}\p{N}_№.+\-]*_[\p{L}\p{N}_№.+\-]+"
IDENTIFIER_TAIL = r"(?:[ ]+[\p{L}\p{N}_№.\-]+)*"
NAME_CHARS = r"\p{L}\p{N}_№+\-"
UNIT_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
BOILERPLATE = (
    r"(?iu)^(?:В этой статье описано|ОБЩАЯ ИНФОРМАЦИЯ$|ПАРАМЕТРЫ И СВОЙСТВА$|РАЗМЕЩЕНИЕ В МОДЕЛИ$|"
    r"РАБОТА С ЭКЗЕМПЛЯРОМ$)"
)
SECRET = (
    r"(?iu)\b(?:sk-[\w-]+|Bearer\s+\S+|(?:api[_ -]?key|token|password|secret|пароль|токен)\s*[:=]\s*\S+)"
)
SECRET_MASK = "[скрыто]"
CLAIM_PATTERN = {
    "purpose": r"(?iu)(?:используют для|предназначен|семейство содержит|позволяет моделировать)",
    "constraints": r"(?iu)(?:нельзя|не допускается|ограничени|только для)",
    "conflict_intro": r"(?iu)^В этой статье.*(?:инструмент|семейств)",
}
CONFLICT_WARNING = "source_conflict: введение называет другое семейство"


def stable_id(*parts: Column | str) -> Column:
    """sha-256 hex of the parts joined by '|'."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times in an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def stem(word: Column) -> Column:
    """Strip one inflection ending from plain words of five letters or more.

    The last letter tells cheaply that most words of other languages have no such ending.
    """
    last = sorted({ending[-1] for ending in ENDINGS})
    plain = (F.length(word) >= 5) & F.substring(word, -1, 1).isin(*last) & ~word.rlike(r"[_\p{Nd}]") & (word != "нельзя")
    return F.when(plain, F.regexp_replace(word, f"(?:{'|'.join(ENDINGS)})$", "")).otherwise(word)


def fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def trim_run(word: Column) -> Column:
    return F.btrim(word, F.lit(".-"))


def keep_word(word: Column) -> Column:
    return (word != "") & ~word.isin(*STOP_WORDS)


def search_tokens(text: Column) -> Column:
    """Folded, trimmed, stop-filtered, stemmed tokens in text order."""
    runs = F.regexp_extract_all(fold(text), F.lit(TOKEN_RUN + "+"), F.lit(0))  # possessive: a run never gives letters back
    words = F.filter(F.transform(runs, trim_run), keep_word)
    return F.transform(words, stem)


def retrieval_tokens(text: Column) -> Column:
    """Search tokens, plus those of the parts (over two characters) of joined identifiers."""
    joined = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)+"), F.lit(0))
    parts = F.filter(F.flatten(F.transform(joined, lambda w: F.split(w, "_"))), lambda w: F.length(w) > 2)
    extra = F.flatten(F.transform(parts, search_tokens))
    return F.when(F.contains(text, F.lit("_")), F.concat(search_tokens(text), extra)).otherwise(search_tokens(text))


def char_grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters, from one pass over the text for each offset."""
    passes = [F.regexp_extract_all(F.substring(text, i + 1, 1 << 30), F.lit(f"(?s).{{{size}}}"), F.lit(0)) for i in range(size)]
    return F.array_distinct(F.concat(*passes) if size > 1 else passes[0])


def entity_name(text: Column) -> Column:
    """The identifier of a heading, with suffix words but without a parenthesis; null if none."""
    pattern = rf"(?U)^({IDENTIFIER}{IDENTIFIER_TAIL})(?:\s+\([^\r\n]*\))?$"
    return bind(F.regexp_extract(strip(text), pattern, 1), lambda found: F.nullif(found, F.lit("")))


def entity_names(text: Column) -> Column:
    """All names of a '/'- or ';'-separated heading; empty unless every part is a name."""
    names = F.transform(F.split(strip(text), r"\s*/\s*|\s*;\s*"), entity_name)
    none = F.array().cast("array<string>")
    return bind(
        names, lambda n: F.when(F.forall(n, lambda x: x.isNotNull()), distinct_ignore_case(n)).otherwise(none)
    )


def distinct_ignore_case(values: Column) -> Column:
    """First spelling of each value, compared without case."""

    def firsts(folded: Column) -> Column:
        return F.filter(values, lambda v, i: F.array_position(folded, F.lower(v)) == i + 1)

    return bind(F.transform(values, F.lower), firsts)


def quote_literal(name: Column) -> Column:
    return F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def contains_name(text: Column, name: Column) -> Column:
    """Whole-identifier, case-insensitive occurrence of a name."""
    pattern = F.concat(
        F.lit(rf"(?iu)(?<![{NAME_CHARS}.])"), quote_literal(name), F.lit(rf"(?![{NAME_CHARS}]|\.[\p{{L}}\p{{N}}])")
    )
    return F.regexp_like(text, pattern)


def is_boilerplate(line: Column) -> Column:
    return strip(line).rlike(BOILERPLATE)


def embedding_input(text: Column, section: Column, names: Column, purpose: Column) -> Column:
    """What is encoded for a chunk: names, purpose, section and text, distinct and non-blank."""
    body = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~is_boilerplate(line)), "\n")
    parts = F.array(F.array_join(names, "; "), F.coalesce(purpose, F.lit("")), F.coalesce(section, F.lit("")), body)
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: strip(p) != "")), "\n")


def mask_secrets(text: Column) -> Column:
    """Mask keys, tokens and passwords; control and format characters and runs of space become one space."""
    masked = F.regexp_replace(text, SECRET, F.lit(SECRET_MASK))
    return squeeze(F.regexp_replace(masked, r"[\p{Cc}\p{Cf}]", " "))


def describe(content: Column) -> Column:
    """First complete fragment: a line, a ';' part, or a sentence that ends before a capital."""
    parts = F.split(strip(content), r"\r?\n|;\s+|(?<=[.!?])\s+(?=[А-ЯЁA-Z])")
    return squeeze(F.coalesce(F.get(F.filter(parts, lambda p: strip(p) != ""), F.lit(0)), content))


def strip_after_marker(text: Column, marker: str) -> Column:
    position = F.instr(text, F.lit(marker))
    return F.when(position > 0, F.substring(text, F.lit(1), position - 1)).otherwise(text)


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def token_estimate(text: Column) -> Column:
    """UTF-8 bytes over four, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def fits_budget(text: Column, instructions: int, reserve: int, limit: int) -> Column:
    return F.octet_length(text) + F.lit(instructions + 64 + reserve) <= limit


def token_pieces(text: Column) -> Column:
    """Tokens with the space before them; together with the trailing space they make up the text."""
    return F.regexp_extract_all(text, F.lit(rf"\s*(?:{UNIT_TOKEN})"), F.lit(0))


#: A tokenizer: from a text to its tokens, each with what stands before it, in order from the start of the text.
Pieces = Callable[[Column], Column]


def token_count(text: Column, pieces: Pieces | None = None) -> Column:
    """Number of tokens; by default runs of letters and digits, and single other marks."""
    return F.size(F.regexp_extract_all(text, F.lit(UNIT_TOKEN), F.lit(0)) if pieces is None else pieces(text))


def python_pieces(cut: Callable[[Sequence[str]], Sequence[Sequence[str]]]) -> Pieces:
    """A tokenizer in Python, called with the texts of an Arrow batch; null has no tokens.

    ``cut`` gives the pieces of each text. Pieces that do not begin the text, one after the other, fail.
    """

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        plain = [t if isinstance(t, str) else "" for t in texts]
        found = [list(p) for p in cut(plain)]
        if len(found) != len(plain) or not all(t.startswith("".join(p)) for t, p in zip(plain, found)):
            raise ValueError("the tokenizer's pieces do not make up the text")
        return pd.Series(found, dtype="object")

    return pieces


def first_non_blank(*values: Column) -> Column:
    return F.coalesce(*[F.when(strip(v) != "", v) for v in values])


def best_value(display: Column, converted: Column, raw: Column, unit: Column) -> Column:
    """Display, else converted, else raw value; the unit only where the converted one won."""
    blank = display.isNull() | (strip(display) == "")
    value = F.when(~blank, display).otherwise(F.coalesce(converted, raw))
    return F.struct(value.alias("value"), F.when(blank & converted.isNotNull(), unit).alias("unit"))
