"""Header and account-name normalization."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _marked_letters() -> tuple[str, str]:
    """Precomposed lower-case letters whose canonical decomposition starts with a plain Latin
    letter, and those letters. Spark has no decomposition function, so ``translate`` stands in."""
    marked, bare = [], []
    for code in range(0xC0, 0x2000):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and "a" <= base <= "z" and letter == letter.lower():
            marked.append(letter)
            bare.append(base)
    return "đ" + "".join(marked), "d" + "".join(bare)


_MARKED, _BARE = _marked_letters()


def normalize_text(text: Column | str) -> Column:
    """Lower case, marks stripped, everything but letters and digits squeezed to one space."""
    value = F.lower(F.col(text) if isinstance(text, str) else text)
    value = F.regexp_replace(F.translate(value, _MARKED, _BARE), r"\p{Mn}+", "")
    return F.coalesce(F.trim(F.regexp_replace(value, "[^a-z0-9]+", " ")), F.lit(""))


def clean_account_name(text: Column | str) -> Column:
    value = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


def normalize_header(text: Column | str) -> Column:
    """Header cell to its lookup key: lower case without byte-order mark, dots, blanks, _, - and /."""
    value = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    return F.regexp_replace(F.translate(value, "﻿.", ""), r"[\s_\-/]+", "")
