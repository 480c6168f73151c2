"""Label cleaning. Every function maps a string column to a string (or flag) column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage import fixed_values as fv

# Unicode separators count as blanks, as they do in the delivered files
BLANKS = r"[\s\x0B\p{Z}]+"


def _collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def normalize_label(c: Column) -> Column:
    """Trimmed, blanks collapsed, upper case; blank becomes null."""
    return F.nullif(F.upper(_collapse(c)), F.lit(""))


@cache
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Every character whose compatibility decomposition is one plain character and marks, and that character; and
    those that stand for several plain characters, or for none."""
    one, many = {}, {}
    for code in range(0xA0, 0x110000):
        letter = chr(code)
        # Hangul syllables are letters of their own, not letters with marks
        if 0xAC00 <= code < 0xD7A4 or 0xD800 <= code < 0xE000 or unicodedata.category(letter) in ("Mn", "Cn", "Co"):
            continue
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", letter) if unicodedata.category(ch) != "Mn")
        if plain != letter:
            (one if len(plain) == 1 else many)[letter] = plain
    return "".join(one), "".join(one.values()), many


def _ranges(letters: Iterable[str]) -> str:
    """A character class of the given letters."""
    codes, parts = sorted(map(ord, letters)), []
    for code in codes:
        if parts and parts[-1][1] == code - 1:
            parts[-1][1] = code
        else:
            parts.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in parts) + "]"


def strip_accents(c: Column) -> Column:
    """Plain characters of any script: compatibility forms (ligatures, full-width letters) by what they stand for, letters
    without their marks, whether letter and mark are one character or two."""
    # of a text's characters beyond ASCII only the distinct ones are looked up
    letters = F.array_distinct(F.split(F.regexp_replace(c, r"[\x00-\x7F]+", ""), ""))
    return F.when(c.rlike(r"[^\x00-\x7F]"), _once(letters, lambda found: _plain(c, found))).otherwise(c)


def _plain(c: Column, letters: Column) -> Column:
    """``c`` in plain characters, where ``letters`` are its distinct characters beyond ASCII."""
    one, plain, many = _plain_letters()
    table = F.map_from_arrays(*(F.split(F.lit("\n".join(side)), "\n") for side in (many.keys(), many.values())))
    # what stands for several characters or none is spelled in characters that stand for themselves
    several = F.filter(letters, lambda ch: ch.rlike(_ranges(many)))
    told = F.aggregate(several, c, lambda text, ch: F.replace(text, ch, F.try_element_at(table, ch)))
    marked = F.exists(letters, lambda ch: ch.rlike(r"\p{Mn}"))
    return F.translate(F.when(marked, F.regexp_replace(told, r"\p{Mn}+", "")).otherwise(told), one, plain)


def transliterate(c: Column) -> Column:
    """Plain letters and apostrophes, the two-letter ligatures included."""
    single_from = fv.EXTRA_LETTERS + fv.APOSTROPHES + "".join(fv.MISREAD_LETTERS)
    single_to = fv.EXTRA_PLAIN + "'" * len(fv.APOSTROPHES) + "".join(fv.MISREAD_LETTERS.values())
    out = F.translate(strip_accents(c), single_from, single_to)
    for letter, pair in fv.DOUBLE_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """A column used several times in an expression but computed once per row."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def relabel(c: Column, synonyms: Mapping[str, str]) -> Column:
    """Replace known labels, keep the others."""
    known = F.create_map(*[F.lit(text) for pair in synonyms.items() for text in pair])
    return _once(c, lambda label: F.coalesce(known[label], label))


def clean_provenance(c: Column) -> Column:
    return relabel(normalize_label(c), fv.PROVENANCE_SYNONYMS)


def clean_category(c: Column) -> Column:
    return relabel(normalize_label(c), fv.CATEGORY_SYNONYMS)


def clean_department(c: Column) -> Column:
    return relabel(normalize_label(c), fv.DEPARTMENT_SYNONYMS)


def clean_country(c: Column) -> Column:
    """Quotes dropped, ``;`` read as a comma, blanks collapsed, upper case."""
    return normalize_label(F.translate(c, ';"“”', ","))


def clean_stay(c: Column) -> Column:
    """``3N`` and ``3 NUITS`` agree, and one night is singular."""
    return relabel(F.regexp_replace(normalize_label(c), r"^([1-9]|1[0-2])N$", "$1 NUITS"), {"1 NUITS": "1 NUIT"})


def clean_commune(c: Column) -> Column:
    """Whole words ``ST`` and ``STE`` are spelled out; other words keep those letters."""
    known = F.create_map(*[F.lit(t) for pair in fv.COMMUNE_SYNONYMS.items() for t in pair])

    def spell(label: Column) -> Column:
        out = F.regexp_replace(label, r"(^|[ '\-])STE([ \-]|$)", "$1SAINTE$2")
        return F.regexp_replace(out, r"(^|[ '\-])ST([ \-]|$)", "$1SAINT$2")

    return _once(normalize_label(c), lambda label: F.coalesce(known[label], spell(label)))


def clean_weekday(c: Column) -> Column:
    return relabel(normalize_label(c), fv.WEEKDAY_SYNONYMS)


def parse_flag(c: Column) -> Column:
    """1 for a word that means yes, 0 for anything else and for null."""
    said_yes = F.lower(F.trim(c)).isin(*fv.TRUE_WORDS)
    return F.coalesce(said_yes, F.lit(False)).cast("int")


def numeric_flag(c: Column) -> Column:
    """Flag columns of the bulk files: ``1.0`` is 1; text, null and what no flag can be (NaN, 1e20) are 0."""
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0))


def separator_key(c: Column) -> Column:
    return F.lower(F.translate(c, "_-", "  "))


def extract_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit("")).try_cast("int")


def extract_bimester(c: Column) -> Column:
    """Number after ``B``, 0 where there is none."""
    return F.coalesce(F.regexp_extract(c, r"B(\d+)", 1).try_cast("int"), F.lit(0))


def clean_text(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("�"), F.lit(" ")))


def collation_key(c: Column) -> Column:
    """Key under which two labels are equal whatever their case and accents, composed or not."""
    return F.upper(strip_accents(c))


def equals_ci_ai(a: Column, b: Column) -> Column:
    """Equality that ignores case and accents, by the key that ids are dealt by."""
    return collation_key(a) == collation_key(b)


def to_csp(c: Column) -> Column:
    """Socio-professional group of a segment, null where the segment belongs to none."""
    pairs = [F.lit(text) for pair in fv.SEGMENT_GROUPS.items() for text in pair]
    return F.create_map(*pairs)[normalize_label(c)]


def first_present(df: DataFrame, candidates: Iterable[str]) -> Column:
    """First non-null value among those candidate columns the frame has."""
    known = [F.col(name).cast("string") for name in candidates if name in df.columns]
    return F.coalesce(*known) if known else F.lit(None).cast("string")


def word_list(c: Column) -> Column:
    """Distinct significant words of a code or a name."""
    words = F.split(F.lower(c), r"""[_\-\s'"]+""")
    return F.array_distinct(
        F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*fv.STOP_WORDS))
    )
