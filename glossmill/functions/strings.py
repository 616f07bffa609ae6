"""Words, n-grams, hyphens, emphasis classes, letter case."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The soft hyphen of OCR text is U+00AC; hyphens that may end a line; marks kept after a corrected word.
SOFT_HYPHEN = "¬"
HYPHENS = "¬-"
FINAL_MARKS = ".,;!?:"


def let(value: Column, then) -> Column:
    """then(value), with value worked out once, though then() uses it for each element of an array."""
    return F.transform(F.array(value), lambda x: then(x))[0]


def words(text: Column, lower: bool = False) -> Column:
    """Runs without white space; none for null."""
    return F.regexp_extract_all(F.coalesce(F.lower(text) if lower else text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def grams(tokens: str, n: int, separator: str = "_") -> Column:
    """All runs of n neighbouring words of the array column `tokens`, joined; none where it is shorter."""
    some = F.transform(F.slice(tokens, 1, F.size(tokens) - (n - 1)), lambda w, i: F.concat_ws(separator, w, *[F.get(tokens, i + k) for k in range(1, n)]))
    return F.when(F.size(tokens) >= n, F.col(tokens) if n == 1 else some).otherwise(F.array().cast("array<string>"))


def utf16_key(text: Column) -> Column:
    """What sorts as the text does by UTF-16 units: characters beyond the first plane come before U+E000, not last."""
    return F.encode(text, "UTF-16BE")


def utf16_length(text: Column) -> Column:
    """UTF-16 units of the text: two for a character beyond the first plane."""
    return (F.octet_length(utf16_key(text)) / 2).cast("int")


def without_final_hyphen(word: Column, hyphens: str = HYPHENS) -> Column:
    """struct(stem, hyphen): the word without a hyphen that follows a letter at its end; else the word itself and null."""
    bare = F.regexp_replace(word, r"\s+$", "")
    pattern = rf"^([\s\S]*\p{{L}})([{hyphens}])$"
    found = bare.rlike(pattern)
    return F.struct(
        F.when(found, F.regexp_extract(bare, pattern, 1)).otherwise(word).alias("stem"),
        F.when(found, F.regexp_extract(bare, pattern, 2)).alias("hyphen"),
    )


def emphasis_class(word: Column) -> Column:
    """NORMAL, START, END or NO: what part a word may have in letter-spaced emphasis.

    A single letter (upper or lower case) or digit is NORMAL, as is ij; two
    characters are END if a letter is followed by punctuation, START if it
    follows.  Empty words are NO.
    """
    return (
        F.when(word.rlike(r"^[\p{Ll}\p{Lu}\p{Nd}]$"), "NORMAL")
        .when(F.lower(word) == "ij", "NORMAL")
        .when(word.rlike(r"^\p{L}\p{P}$"), "END")
        .when(word.rlike(r"^\p{P}\p{L}$"), "START")
        .otherwise("NO")
    )


def edit_type(original: Column, result: Column) -> Column:
    """Numbers of words before and after, as in 2-1."""
    return F.concat(F.size(original).cast("string"), F.lit("-"), F.size(result).cast("string"))


def edit_class(kind: Column) -> Column:
    """edit where the number of words stays, merge where it falls, split otherwise."""
    return F.when(kind.isin("1-1", "2-2", "3-3"), "edit").when(kind.isin("2-1", "3-1", "3-2"), "merge").otherwise("split")


def apply_rules(word: Column, rules: list[tuple[str, str]]) -> Column:
    """Each (pattern, replacement) in turn on what the ones before have made."""
    return reduce(lambda w, r: F.regexp_replace(w, r[0], r[1]), rules, word)


def recase(word: Column, like: Column) -> Column:
    """word in the letter case of `like`: all capitals, an initial capital, or as it is.

    What is no letter counts as small, so A.B isn't all capitals.
    """
    capitals, initial = like.rlike(r"^\p{Lu}+$"), like.rlike(r"^\p{Lu}")
    return F.when(capitals, F.upper(word)).when(initial, F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))).otherwise(word)


def final_mark(word: Column, clean: Column) -> Column:
    """The word's last character, if it is a mark that the clean form doesn't end in."""
    last = F.substr(word, F.lit(-1))
    return F.when(F.lit(FINAL_MARKS).contains(last) & (last != "") & (F.substr(clean, F.lit(-1)) != last), last).otherwise("")


def document_id(path: Column) -> Column:
    """A name for a document from its path: no folder, no extensions, and a letter first, as XML ids need."""
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"(\.(gz|bz2))?$", "")
    stem = F.translate(F.regexp_replace(base, r"(\.[a-z]+)+$", ""), ": ", "__")
    return F.when(stem.rlike(r"^[A-Za-z_]"), stem).otherwise(F.concat(F.lit("doc-"), stem))


def is_numeric(word: Column) -> Column:
    """Whether the whole word reads as a number."""
    return word.try_cast("double").isNotNull()
