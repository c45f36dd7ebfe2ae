"""Tokenising, naming and matching helpers, all as built-in column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never make a story term.
STOP_WORDS = """
the and for with his her has have had are was were been being this that these those they them their will would could
should might may can cant from into onto over under about above after before between during while when where why how
what who whom whose which than then thus also even just only some such each every either both one two not nor but yet
all any too very following widespread according regarding involving ongoing said says gets got getting goes went going
come comes came make makes made making take takes took taken taking give gives gave given giving video videos channel
subscribe patreon discord twitter follow link links description comment comments like likes today tonight yesterday
tomorrow now new latest breaking update updates news report reports watch see seen show shows showing live stream
streaming people person man woman men women kid kids thing things something anyone everyone nothing
""".split()

# Number words folded into digits when names are compared.
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
                "eight": "8", "nine": "9", "ten": "10"}


def _compatible() -> dict[str, str]:
    """Letters whose compatibility decomposition, without its marks, is plain ASCII; built from the Unicode tables."""
    found = {}
    for code in range(0x80, 0x20000):  # no letter beyond has such a form
        if not 0xD800 <= code < 0xE000:
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
            if plain and plain != chr(code) and plain.isascii():
                found[chr(code)] = plain
    return found


_PLAIN = _compatible()
_SINGLE = {k: v for k, v in _PLAIN.items() if len(v) == 1}
_SEVERAL = {k: v for k, v in _PLAIN.items() if len(v) > 1}


def bound(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`, which may use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(**columns: Column) -> Column:
    """Columns to select that are worked out once a row: filters on them stay above, where Spark would else repeat the work below."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def fold_accents(text: Column) -> Column:
    """Compatibility forms of ASCII letters (accents, full width, ligatures) to those letters; loose marks are dropped.

    Text that is plain ASCII, one byte a letter, is left as it is.
    """
    table = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    letters = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
    spelled = F.when(text.rlike("[" + "".join(_SEVERAL) + "]"), F.array_join(letters, "")).otherwise(text)
    folded = F.regexp_replace(F.translate(spelled, "".join(_SINGLE), "".join(_SINGLE.values())), "[̀-ͯ]", "")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)


def story_tokens(text: Column, *, opener_chars: int | None = None) -> Column:
    """Topic-bearing words of a description, or of its first letters only: runs of three letters or apostrophes and more."""
    lowered = F.lower(text if opener_chars is None else F.substring(text, 1, opener_chars))
    clean = F.when(F.contains(lowered, F.lit("http")), F.regexp_replace(lowered, r"https?://\S+", " ")).otherwise(lowered)
    return F.filter(F.regexp_extract_all(clean, F.lit("[a-z']{3,}"), 0), lambda t: ~t.isin(STOP_WORDS))


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs, joined by a space."""
    n = F.size(tokens)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))),
                   lambda a, b: F.concat_ws(" ", a, b)))


def term_set(tokens: Column) -> Column:
    """Distinct words and pairs; pass a computed column, so the text is tokenised once."""
    return F.array_distinct(F.concat(tokens, bigrams(tokens)))


def speech_tokens(text: Column) -> Column:
    """Spoken words: bracketed cues out, then runs of letters, digits and apostrophes."""
    lowered = F.lower(text)
    clean = F.when(F.contains(lowered, F.lit("[")), F.regexp_replace(lowered, r"\[[^\]]*\]", " ")).otherwise(lowered)
    return F.regexp_extract_all(clean, F.lit("[a-z0-9']+"), 0)


def phrase_key(text: Column) -> Column:
    """' words only ' so that one phrase can be looked up inside another."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def slug(name: Column) -> Column:
    dashed = F.regexp_replace(fold_accents(F.lower(name)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "(^-|-$)", "")


def name_key(name: Column) -> Column:
    """What is left of a subject name once mechanical spelling variation is gone."""
    text = F.regexp_replace(F.lower(fold_accents(F.coalesce(name, F.lit("")))), "&", " and ")
    text = F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))
    text = F.regexp_replace(text, r"^the (?=\S)", "")
    digits = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    words = F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(digits, w), w))

    def without_tail(w: Column) -> Column:
        kept = F.array_max(F.transform(w, lambda x, i: F.when(x.isin("case", "saga"), 0).otherwise(i + 1)))
        return F.slice(w, 1, F.greatest(kept, F.lit(1)))

    def joined(w: Column) -> Column:
        middle = F.filter(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), lambda x: F.length(x) > 1)
        short = F.concat(F.slice(w, 1, 1), middle, F.slice(w, -1, 1))
        return F.when(F.size(w) >= 3, F.array_join(short, " ")).otherwise(F.array_join(w, " "))

    return bound(bound(words, without_tail), joined)


def name_colour(name: Column) -> Column:
    """A stable colour: 32-bit rolling hash of the name to a hue at fixed saturation and lightness."""
    letters = F.filter(F.split(name, ""), lambda c: F.length(c) > 0)
    h = F.aggregate(letters, F.lit(0).cast("bigint"),
                    lambda acc, c: (acc * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))
    hue = (h % 360) / 360.0
    lightness, spread = 0.56, 0.6 * min(0.56, 1 - 0.56)

    def channel(n: int) -> Column:
        k = (F.lit(float(n)) + hue * 12) % 12
        level = F.lit(lightness) - F.lit(spread) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.floor(255 * level + 0.5).cast("bigint"))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(8), channel(4))


# Address forms that carry an 11-character video id.
VIDEO_ID_PATTERNS = [r"i\.ytimg\.com/vi/([A-Za-z0-9_-]{11})/",
                     r"youtube\.com/(?:embed/|watch\?v=)([A-Za-z0-9_-]{11})",
                     r"youtu\.be/([A-Za-z0-9_-]{11})"]


def video_ids(text: Column) -> Column:
    """All video ids mentioned in a text, each once."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in VIDEO_ID_PATTERNS]))


def snippet(text: Column, *, limit: int = 260) -> Column:
    """One-line preview with an ellipsis when something was cut."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)


def first_line(text: Column, *, limit: int = 120) -> Column:
    return F.substring(F.split(text, "\n")[0], 1, limit)


def tidy_label(text: Column) -> Column:
    return F.trim(F.translate(F.coalesce(text, F.lit("")), "�’", "''"))
