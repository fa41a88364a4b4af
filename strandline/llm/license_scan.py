"""License notices: exact phrases, and near ones found by pigeonhole seeds and bounded-error matching."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table

#: Phrase and label of the exact scan. Fixed values.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Phrase, label and the number of character edits allowed in the near scan.
NOTICES = (
    ("under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    ("apache license version 2", "apache-2", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("mozilla public license", "mpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("boost software license", "bsl", 2),
    ("all rights reserved", "all-rights-reserved", 1),
)
#: A-Z to lower case; every other ASCII byte that is not 0-9 or a-z to a space. Bytes from 128 on are letters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def seeds_of(phrase: bytes, edits: int) -> list[tuple[int, bytes]]:
    """``edits + 1`` pieces with their offsets: whatever at most ``edits`` edits do, one piece stays whole."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def compile_notices(notices=NOTICES) -> list[tuple]:
    """(label, phrase, edits, seeds, patterns for 0, 1, ... edits) of each notice. Matches start and end at word limits."""
    out = []
    for phrase, label, edits in notices:
        raw = phrase.encode()
        patterns = [regex.compile(rb"(?<=\x20)(?:%s){e<=%d}(?=\x20)" % (regex.escape(raw, literal_spaces=True), e)) for e in range(edits + 1)]
        out.append((label, raw, edits, seeds_of(raw, edits), patterns))
    return out


def near_spans(line: bytes, notices: list[tuple]) -> list[tuple[int, int, str, int, int]]:
    """(start, end, label, edits, phrase length) of near matches in space-joined words with a space before and after.

    Each occurrence of a seed opens a window in which its phrase can lie; windows of one phrase that overlap
    are merged, and the patterns decide inside: matches without edits first, then those of one edit in what is left
    between them, and so on, so that none hides another beside it, in time linear in the window.
    """
    found = []
    for label, phrase, edits, seeds, patterns in notices:
        windows = []
        for offset, piece in seeds:
            at = line.find(piece)
            while at >= 0:
                windows.append((max(0, at - offset - edits - 1), at - offset + len(phrase) + edits + 1))
                at = line.find(piece, at + 1)
        if not windows:
            continue
        windows.sort()
        lo, hi = windows[0]
        merged = []
        for a, b in windows[1:]:
            if a <= hi:
                hi = max(hi, b)
            else:
                merged.append((lo, hi))
                lo, hi = a, b
        merged.append((lo, hi))
        for lo, hi in merged:
            parts = [(lo, hi)]
            for e, pattern in enumerate(patterns if patterns[-1].search(line, lo, hi) else ()):
                left = []
                for lo, hi in parts:
                    for hit in pattern.finditer(line, lo, hi):
                        found.append((hit.start(), hit.end(), label, e, len(phrase)))
                        left.append((lo, hit.start()))
                        lo = hit.end()
                    left.append((lo, hi))
                parts = [(lo, hi) for lo, hi in left if hi - lo > len(phrase) - edits]
    return sorted(found)


def scan_text(text: str | None, notices: list[tuple], base=BASE) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, all labels, score, near spans in words)."""
    words = words_of(text)
    line = b" %s " % b" ".join(words)
    # word k starts after space k, so places in words are found by bisection, however many notices there are
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    places, base_labels = [], set()
    for phrase, label in base:
        raw = b" %s " % phrase.encode()
        at = line.find(raw)
        while at >= 0:
            places.append(int(np.searchsorted(spaces, at)))
            base_labels.add(label)
            at = line.find(raw, at + 1)
    spans = near_spans(line, notices)
    labels = base_labels | {s[2] for s in spans}
    score = 1.0 if base_labels else max((1 - e / size for _, _, _, e, size in spans), default=0.0)
    near = [(int(np.searchsorted(spaces, a)) - 1, int(np.searchsorted(spaces, b)), label, e) for a, b, label, e, _ in spans]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, near


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word:long,end_word:long,label:string,edits:int>>"


def scan_licenses(docs: DataFrame, text: str = "text", notices=NOTICES) -> DataFrame:
    """``docs`` with the columns of SCHEMA added, replacing columns of these names.

    Words are maximal runs of 0-9, a-z and non-ASCII characters after A-Z are lower-cased. ``n_base`` counts
    every place where a base phrase's words stand in a row, ``first_word`` and ``last_word`` are the smallest and
    largest such start. ``spans`` are near matches (end exclusive, in words), ``labels`` joins both kinds, and
    ``score`` is 1 with a base match, else the best near match's share of unedited characters, else 0. Null and
    empty texts have no words and score 0; repeated rows are scanned one by one; texts of any length are whole.
    """
    compiled = None

    @F.pandas_udf(f"struct<{SCHEMA}>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        nonlocal compiled
        compiled = compiled or compile_notices(notices)
        for texts in batches:
            rows = [scan_text(t, compiled) for t in texts]
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(NAMES)})

    return docs.drop(*NAMES).withColumn("_scan", scan(text)).select("*", "_scan.*").drop("_scan")


NAMES = [re.split(r"[ :]", part)[0] for part in re.split(r", (?=[a-z_]+ )", SCHEMA)]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every text of ``documents``."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES: dict[str, str] = {}
