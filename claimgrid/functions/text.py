"""Text expressions: accent folding, normalisation, masking, match keys, chunks and tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgrid import fixed as X


def _fold_pairs():
    """Precomposed letters whose canonical decomposition is one base letter plus combining marks."""
    src, dst = ["đ", "Đ"], ["d", "D"]
    for lo, hi in ((0x00C0, 0x024F), (0x1E00, 0x1EFF)):
        for cp in range(lo, hi + 1):
            base = [ch for ch in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(ch) != "Mn"]
            if len(base) == 1 and base[0] != chr(cp):
                src.append(chr(cp))
                dst.append(base[0])
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = _fold_pairs()


def squeeze(c: Column) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Accent-free lower case with collapsed blanks; NULL folds to the empty string."""
    bare = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _FOLD_FROM, _FOLD_TO), r"\p{Mn}", "")
    return squeeze(F.lower(bare))


def norm(c: Column) -> Column:
    """Lower case with collapsed blanks, accents kept."""
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; there is no built-in for it."""
    return s.str.normalize("NFC")


def match_key(group: Column, name: Column, unit: Column) -> Column:
    return F.concat_ws("|", fold(group), fold(name), fold(unit))


def python_strip(c: Column, chars: str) -> Column:
    """Strip any of the given characters from both ends."""
    cls = "[" + "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in chars) + "]+"
    return F.regexp_replace(F.regexp_replace(c, "^" + cls, ""), cls + "$", "")


def safe_name(c: Column, limit: int = 60) -> Column:
    """A file name without forbidden signs; a name over the limit is cut and ends with a hash of the whole, so none collide."""
    clean = F.regexp_replace(c, r'[\\/:*?"<>|]+', "_")
    short = F.concat(python_strip(F.substring(clean, 1, limit), " ._"), F.lit("_"), F.substring(F.md5(clean), 1, 8))
    return F.when(F.length(clean) > limit, short).otherwise(python_strip(clean, " ._"))


def content_key(content: Column, model: Column, masked: Column, whole: Column) -> Column:
    """Cache key of an extraction request: content hash, model and mode flags."""
    return F.concat_ws(
        "_", F.substring(F.sha1(content), 1, 16), safe_name(model, 30),
        F.when(masked, "ad").otherwise("goc"), F.when(whole, "ca").otherwise("rg"))


def mask_numbers_and_people(c: Column) -> Column:
    c = F.regexp_replace(c, "(?U)" + X.PERSON, "$1 [CA_NHAN]")
    c = F.regexp_replace(c, "(?U)" + X.LONG_NUMBER, "[SO]")
    return F.regexp_replace(c, "(?U)" + X.PHONE, "[SO]")


def _quote_pattern(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\\[\](){}.*+?^$|\-])", r"\\$1")


def mask_pii(text: Column, party_a: Column, party_b: Column) -> Column:
    """Hide both party names (longer than five characters, any case), people and long numbers."""
    for name, tag in ((party_a, X.PARTY_TAGS["TC-06"]), (party_b, X.PARTY_TAGS["TC-07"])):
        pat = F.concat(F.lit("(?iu)"), _quote_pattern(name))
        text = F.when(F.length(name) > 5, F.regexp_replace(text, pat, F.lit(tag))).otherwise(text)      # name NULL: unchanged
    return mask_numbers_and_people(text)


def chunk_starts(text: Column, size: int = 900, overlap: int = 150) -> Column:
    """Start offsets (0-based) of the overlapping chunks; no chunk for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(r"([a-z0-9]+)"), 1)


def est_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 3)


def window_class(text: Column) -> Column:
    """Context size that holds the text with 3 000 spare tokens: 32k, 48k or 64k."""
    need = est_tokens(text) + 3000
    return F.when(need <= 32768, 32768).when(need <= 49152, 49152).otherwise(65536)


def over_length_share(text: Column) -> Column:
    """Whole per cent of the text that fits when even the largest window is too small, else NULL."""
    need = est_tokens(text) + 3000
    return F.when(need > 65536, F.floor(F.lit(65536 * 100) / need))


def contains_pattern_folded(text: Column, *patterns: str) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def period_number(path: Column) -> Column:
    """Period number written in a file name, accented or folded."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    a = F.regexp_extract(name, r"(?iu)đợt\s*0*(\d+)", 1)
    b = F.regexp_extract(fold(name), r"dot\s*0*(\d+)", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))).try_cast("int")
