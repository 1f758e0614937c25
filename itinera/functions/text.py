"""Text functions (H1-H13, H20-H22, H24) as Column -> Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from itinera import constants as K

# Characters that count as white space, as a regex class body.
WHITESPACE = (r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
              r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# Dash and apostrophe variants folded to the ASCII form.
DASHES = "–—−‐‑"
APOSTROPHES = "’‘`´"
# All but A-Z, a-z, À-ÿ, 0-9, hyphen and apostrophe; as a list of ranges a fifth of the time of the negated class.
OTHERS = r"\x00-&(-,./:-@\[-`{-\x{bf}\x{100}-\x{10ffff}"
# Word character: any letter, any number, underscore.
WORD = r"[\p{L}\p{N}_]"


def accent_table(keep_cedilla: bool) -> tuple[str, str]:
    """``translate`` arguments that strip accents.

    The table follows from one rule: a letter of the Latin, Greek or Cyrillic
    blocks maps to its canonical decomposition without combining marks; the
    marks themselves have no counterpart, which makes ``translate`` drop them.
    """
    source, target = [], []
    blocks = ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000))
    for code in (c for lo, hi in blocks for c in range(lo, hi)):
        char = chr(code)
        if keep_cedilla and char in "çÇ":
            continue
        bare = "".join(d for d in unicodedata.normalize("NFD", char)
                       if unicodedata.category(d) != "Mn")
        if bare != char and len(bare) == 1:
            source.append(char)
            target.append(bare)
    marks = [chr(c) for c in range(0x300, 0x370)
             if unicodedata.category(chr(c)) == "Mn"]
    return "".join(source + marks), "".join(target)


_STRIP_ALL = accent_table(keep_cedilla=False)
_STRIP_KEEP = accent_table(keep_cedilla=True)


def _text(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit(""))


def _squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, f"[{WHITESPACE}]+", " "))


def normalize_text(col, lowercase: bool = True, remove_extra_spaces: bool = True) -> Column:
    """H1: squeeze white space and lower-case; null becomes ''."""
    out = _squeeze(_text(col)) if remove_extra_spaces else _text(col)
    out = F.lower(out) if lowercase else out
    return F.regexp_replace(out, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "") \
        if not remove_extra_spaces else out


def remove_accents(col, keep_cedilla: bool = True) -> Column:
    """H2: drop accents, by default keeping the cedilla."""
    return F.translate(_text(col), *(_STRIP_KEEP if keep_cedilla else _STRIP_ALL))


def normalize_hyphens(col) -> Column:
    """H3: one ASCII hyphen for the dash variants."""
    return F.translate(_text(col), DASHES, "-" * len(DASHES))


def normalize_apostrophes(col, legacy: bool = False) -> Column:
    """H4: one ASCII apostrophe; ``legacy=True`` leaves the text alone (policy P1)."""
    if legacy:
        return _text(col)
    return F.translate(_text(col), APOSTROPHES, "'" * len(APOSTROPHES))


def remove_non_alphanumeric(col, keep_spaces=True, keep_hyphens=True,
                            keep_apostrophes=True) -> Column:
    """H5: blank out every character outside the keep set, then squeeze.

    White space is squeezed to one blank whether it is kept or blanked out, so
    ``keep_spaces`` changes nothing and one pass over runs of other characters does both.
    """
    blanked = OTHERS + ("" if keep_hyphens else r"\-") + ("" if keep_apostrophes else "'")
    return F.trim(F.regexp_replace(_text(col), f"[{blanked}]+", " "))


def tokenize(col, keep_punctuation: bool = False) -> Column:
    """H6: words, or words with inner marks plus single punctuation characters."""
    pattern = (f"{WORD}+(?:[-']{WORD}+)*|[^\\p{{L}}\\p{{N}}_{WHITESPACE}]"
               if keep_punctuation else f"{WORD}+")
    return F.regexp_extract_all(_text(col), F.lit(pattern), F.lit(0))


def matching_form(col, legacy_apostrophes: bool = False) -> Column:
    """H7: the form all dictionary keys and texts are compared in.

    H3, H4 and H2 are character maps, so they fold into a single ``translate``;
    the squeeze of H1 and the blanking of H5 fold into a single regex pass.
    """
    apostrophes = "" if legacy_apostrophes else APOSTROPHES
    source = DASHES + apostrophes + _STRIP_KEEP[0]
    target = "-" * len(DASHES) + "'" * len(apostrophes) + _STRIP_KEEP[1]
    folded = F.lower(F.translate(_text(col), source, target))
    return F.trim(F.regexp_replace(folded, f"[{OTHERS}]+", " "))


def split_name(col) -> Column:
    """H8: parts of a compound name."""
    parts = F.split(_text(col), f"[-{WHITESPACE}]+")
    return F.filter(parts, lambda p: p != "")


def fuzzy_key(col) -> Column:
    """H9: only a-z and 0-9 remain."""
    return F.regexp_replace(F.lower(remove_accents(col, keep_cedilla=False)), "[^a-z0-9]", "")


def quoted_fragments(col) -> Column:
    """Double-quoted fragments, then single-quoted ones."""
    text = _text(col)
    return F.concat(F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1)),
                    F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1)))


def clean_id(col) -> Column:
    """Trimmed id, '' for null."""
    return normalize_text(col, lowercase=False, remove_extra_spaces=False)


def comparison_form(col) -> Column:
    """Form in which predicted and true places are compared."""
    text = _text(col)
    plain = F.translate(F.trim(F.lower(text)),
                        "àáâäèéêëìíîïòóôöùúûüçñ", "aaaaeeeeiiiioooouuuucn")
    return (F.when(text == "", "")
            .when(F.upper(text) == "INVALID", "INVALID")
            .otherwise(plain))


def station_form(col) -> Column:
    """Lower-case, accent-free station name with letters, digits, space and hyphen."""
    bare = F.lower(remove_accents(col, keep_cedilla=False))
    return _squeeze(F.regexp_replace(bare, f"[^\\p{{L}}\\p{{N}}_{WHITESPACE}-]", ""))


def label_tokens(col) -> Column:
    """Tokens for labelling; hyphens stay as tokens, trailing marks split off."""
    words = F.filter(F.split(_squeeze(_text(col)), " "), lambda w: w != "")
    shape = r"^([\p{L}\p{N}_']+)([.,!?;:]+)?$"

    def pieces(word: Column) -> Column:
        hyphenated = F.split(F.replace(word, F.lit("-"), F.lit("\n-\n")), "\n")
        punctuated = F.array(F.regexp_extract(word, shape, 1), F.regexp_extract(word, shape, 2))
        split_word = (F.when(~word.rlike("[-.,!?;:]"), F.array(word))  # the most of words, at one look
                      .when(word.contains("-"), hyphenated)
                      .when(word.rlike(shape), punctuated)
                      .otherwise(F.array(word)))
        return F.filter(split_word, lambda t: t != "")

    return F.flatten(F.transform(words, pieces))


def join_tokens(tokens: Column) -> Column:
    """A name from its tokens, with no spaces round hyphens."""
    def step(acc: Column, token: Column) -> Column:
        hyphen = F.when(acc == "", acc).otherwise(F.concat(acc, F.lit("-")))
        glued = F.when((acc == "") | acc.endswith("-"), F.concat(acc, token)) \
            .otherwise(F.concat(acc, F.lit(" "), token))
        return F.when(token == "-", hyphen).otherwise(glued)

    return F.aggregate(tokens, F.lit(""), step)


def drop_leading_prepositions(col) -> Column:
    """Strip prepositions at the head; text made of prepositions only stays."""
    raw = F.col(col) if isinstance(col, str) else col
    one_of = "|".join(K.LEADING_PREPOSITIONS)
    squeezed = _squeeze(raw)
    return (F.when(squeezed.rlike(f"(?iu)^(?:(?:{one_of})(?: |$))*$"), raw)
            .otherwise(F.regexp_replace(squeezed, f"(?iu)^(?:(?:{one_of}) )+", "")))


def output_line(sentence_id, origin, destination) -> Column:
    """``id,origin,destination`` with INVALID for a missing end."""
    def shown(col):
        col = F.col(col) if isinstance(col, str) else col
        return F.coalesce(F.nullif(col, F.lit("")), F.lit("INVALID"))

    sid = F.col(sentence_id) if isinstance(sentence_id, str) else sentence_id
    return F.concat_ws(",", sid.cast("string"), shown(origin), shown(destination))


def word_count(col) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(_squeeze(_text(col)), " "), lambda w: w != ""))


def seeded_hash(seed: int, col) -> Column:
    """Sort key of every seeded sample or shuffle: ``md5(seed|id)``."""
    key = F.col(col) if isinstance(col, str) else col
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
