"""Operators that repeat until nothing changes, or that share state over a whole chapter.

Columns cannot express these, so each group - the windows of a chapter or the
chapters of a session, at most a few thousand rows - goes to one Python call
through ``applyInPandas``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.vocabulary import STOP_WORDS, SUFFIXES


def floor_quantile(values, q: float) -> float:
    v = np.sort(np.asarray(values, float))
    return float(v[int(q * (len(v) - 1))]) if len(v) else 0.0


def unit_ranks(values) -> np.ndarray:
    """Rank of each distinct value, from 0 to 1."""
    distinct, at = np.unique(np.asarray(values, float), return_inverse=True)
    return at / max(1, len(distinct) - 1)


def _stem(word: str) -> str:
    hit = next((s for s in SUFFIXES if len(word) > 4 and word.endswith(s)), "")
    return word[:len(word) - len(hit)]


def topic_likeness(a: str | None, b: str | None) -> float:
    """1 for equal topics, else the Jaccard similarity of their stemmed words; 0 when both are empty."""
    a, b = (a or "").lower(), (b or "").lower()
    if not a and not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = ({_stem(w) for w in re.sub(r"[^a-z0-9\s]", " ", t).split() if w not in STOP_WORDS} for t in (a, b))
    if not x or not y:
        return float(x == y)
    return len(x & y) / len(x | y)


@dataclass
class Chapter:
    """The windows of one chapter, in order, with what smoothing needs to know about them."""

    rows: pd.DataFrame
    salience: np.ndarray = field(init=False)
    cut: float = field(init=False)
    anchors: list[int] = field(init=False)

    def __post_init__(self) -> None:
        r = self.rows
        self.start, self.end = r["start"].to_numpy(float), r["end"].to_numpy(float)
        self.length = self.end - self.start
        self.topic, self.goes_on = r["topic"].tolist(), r["same_prev"].fillna(False).to_numpy(bool)
        self.salience = (0.45 * unit_ranks(r["burst"].fillna(0)) + 0.25 * unit_ranks(r["z"].fillna(0).clip(lower=0))
                         + 0.20 * unit_ranks(r["reactions"].fillna(0)) + 0.10 * unit_ranks(r["confidence"].fillna(0)))
        self.short, self.middle, self.longest = (floor_quantile(self.length, q) for q in (0.25, 0.5, 0.95))
        self.wide = floor_quantile(np.maximum(0, self.start[1:] - self.end[:-1]), 0.9)
        pad = np.concatenate([[-1.0], self.salience, [-1.0]])
        left, right = pad[:-2], pad[2:]
        s = self.salience
        peak = (s >= left) & (s >= right) & ((s > left) | (s > right))
        fives = int((self.end[-1] - self.start[0]) / 60 // 5)
        low, high = max(1, fives), max(2, fives * 3, max(1, fives))
        cuts = [floor_quantile(s, q) for q in (0.70, 0.75, 0.80, 0.85, 0.90)]
        fits = [c for c in cuts if low <= ((s >= c) | peak).sum() <= high]
        self.cut = fits[0] if fits else cuts[2]
        self.anchors = []
        for i in np.flatnonzero((s >= self.cut) | peak):
            if self.anchors and self.start[i] - self.end[self.anchors[-1]] < self.middle:
                if s[i] > s[self.anchors[-1]]:
                    self.anchors[-1] = int(i)
            else:
                self.anchors.append(int(i))

    def gap(self, i: int, j: int) -> float:
        a, b = min(i, j), max(i, j)
        return max(0.0, self.start[b] - self.end[a])

    def pull(self, member: int, other: int) -> float:
        """How strongly a member of a section draws another window to it."""
        return 0.6 * topic_likeness(self.topic[member], self.topic[other]) + 0.3 / (1 + self.gap(member, other)) + 0.1 * self.salience[member]

    def joins(self, edge: int, new: int) -> bool:
        """Whether a section may grow over ``new`` next to its edge: near, short, not salient, and no topic boundary between."""
        like = topic_likeness(self.topic[edge], self.topic[new])
        boundary = like < 0.3 and not self.goes_on[max(edge, new)]
        return self.gap(edge, new) <= self.wide and self.length[new] <= self.short and self.salience[new] < self.cut and not boundary

    def sections(self) -> list[tuple[int, int]]:
        n, taken, out = len(self.start), set(), []
        fixed = set(self.anchors)
        for a in self.anchors:
            if a in taken:
                continue
            lo = hi = a
            taken.add(a)
            while True:
                ends = [(e, x) for e, x in ((lo, lo - 1), (hi, hi + 1)) if 0 <= x < n and x not in taken and x not in fixed and self.joins(e, x)]
                if not ends:
                    break
                edge, new = max(ends, key=lambda p: self.pull(*p))
                taken.add(new)
                lo, hi = min(lo, new), max(hi, new)
                if self.end[hi] - self.start[lo] > min(self.longest, 480):
                    break
            out.append((lo, hi))
        return self._absorb(self._adopt(out))

    def _adopt(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Windows without a section go to the neighbouring one that draws them most, the left one on a tie."""
        spans = list(spans)
        for i in range(len(self.start)):
            if any(lo <= i <= hi for lo, hi in spans):
                continue
            before = [k for k, (lo, hi) in enumerate(spans) if hi < i]
            after = [k for k, (lo, hi) in enumerate(spans) if lo > i]
            options = []
            if before:
                k = max(before, key=lambda k: spans[k][1])
                options.append((self.pull(spans[k][1], i), k))
            if after:
                k = min(after, key=lambda k: spans[k][0])
                options.append((self.pull(spans[k][0], i), k))
            if options:
                k = max(options, key=lambda o: o[0])[1]
                spans[k] = (min(spans[k][0], i), max(spans[k][1], i))
            else:
                spans.append((i, i))
        return sorted(spans)

    def _absorb(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Short, unsalient single windows join the stronger neighbour, until none is left."""
        def rep(span: tuple[int, int]) -> int:
            return span[0] + int(np.argmax(self.salience[span[0]:span[1] + 1]))

        i, changed = 0, False
        while True:
            if i >= len(spans):
                if not changed:
                    return spans
                i, changed = 0, False
                continue
            lo, hi = spans[i]
            options = [(self.pull(rep(spans[k]), lo), k) for k in (i - 1, i + 1) if 0 <= k < len(spans)]
            if lo == hi and self.length[lo] <= self.short and self.salience[lo] < self.cut and options and max(options)[0] > 0:
                k = max(options, key=lambda o: o[0])[1]
                spans[k] = (min(spans[k][0], lo), max(spans[k][1], hi))
                spans.pop(i)
                changed = True
            else:
                i += 1


def smooth_sections(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sections of a chapter's windows: (keys, section, start, end, n, first, last).

    ``df`` has id, start, end, topic, same_prev, burst, z, reactions, confidence.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end", "id"]).reset_index(drop=True)
        spans = Chapter(pdf).sections()
        return pd.DataFrame([{**{k: pdf[k][0] for k in keys}, "section": n + 1, "start": pdf["start"][lo], "end": pdf["end"][lo:hi + 1].max(),
                              "n": hi - lo + 1, "first": pdf["id"][lo], "last": pdf["id"][hi]} for n, (lo, hi) in enumerate(spans)])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", section long, start double, end double, n long, first string, last string"
    cols = [*keys, "id", "start", "end", "topic", "same_prev", "burst", "z", "reactions", "confidence"]
    return df.select(*cols).groupBy(*keys).applyInPandas(run, schema)


def merge_short_chapters(df: DataFrame, keys: list[str], minutes: float) -> DataFrame:
    """Chapters below ``minutes`` merged into the longer neighbour, the next on a tie, until none is left or one remains.

    ``df`` has start, end, name; the longer of two keeps its name, the left one on a tie.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.start, r.end, r.name_) for r in pdf.rename(columns={"name": "name_"}).sort_values(["start", "end"]).itertuples()]

        def length(k: int) -> float:
            return rows[k][1] - rows[k][0] if 0 <= k < len(rows) else -1.0

        while len(rows) > 1:
            short = next((k for k in range(len(rows)) if length(k) < minutes * 60), None)
            if short is None:
                break
            a = short if length(short + 1) >= length(short - 1) else short - 1
            name = rows[a][2] if length(a) >= length(a + 1) else rows[a + 1][2]
            rows[a:a + 2] = [(rows[a][0], rows[a + 1][1], name)]
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "start": s, "end": e, "name": n} for s, e, n in rows])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", start double, end double, name {kinds['name']}"
    return df.select(*keys, "start", "end", "name").groupBy(*keys).applyInPandas(run, schema)


def clutch_arcs(df: DataFrame, keys: list[str], least: float, most: float, like: float = 0.55, grace: float = 240.0, ahead: float = 120.0,
                tau: float = 600.0) -> DataFrame:
    """Arcs around peaks: a peak grows to the left over build-up or similar ranges until ``least``, to the right over
    endings, active neighbours or similar ranges until ``most``, and past it only to an ending within the grace.

    ``df`` has id, start, end, topic, chapter, role, energy, avg_z and vector (null: like nothing).  Ranges are alike by
    their cosine, their distance in time and their topic.  An arc uses up the ranges within its span; ``members`` are
    its ids in order.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(["start", "end"]).reset_index(drop=True)
        s, e = r["start"].to_numpy(float), r["end"].to_numpy(float)
        role, topic, chapter = r["role"].fillna("").tolist(), r["topic"].tolist(), r["chapter"].tolist()
        vector = [None if v is None else np.asarray(v, float) for v in r["vector"]]
        peak = np.array([a == "peak" for a in role]) | ((r["avg_z"].to_numpy(float) >= 0.6) & (r["energy"] == "high").to_numpy())
        ending = np.array([a == "resolution" for a in role])
        active = np.array([a in ("peak", "conflict", "resolution") for a in role])
        used, out, n = np.zeros(len(r), bool), [], len(r)

        def sim(i: int, j: int) -> float:
            i, j = min(i, j), max(i, j)
            a, b, cosine = vector[i], vector[j], -1.0
            if a is not None and b is not None and a.any() and b.any():
                cosine = float(a @ b / np.sqrt((a @ a) * (b @ b)))
            same = bool(topic[i]) and topic[i] == topic[j]
            return 0.7 * (cosine + 1) / 2 + 0.2 * np.exp(-max(0.0, s[j] - e[i]) / tau) + 0.1 * same

        for seed in np.flatnonzero(peak):
            if used[seed]:
                continue
            members = [int(seed)]
            total = e[seed] - s[seed]
            j = seed - 1
            while j >= 0 and total < least:
                if not used[j]:
                    if role[j] not in ("build_up", "conflict") and sim(j, members[0]) < max(0.35, like - 0.1):
                        break
                    members.insert(0, int(j))
                    total += e[j] - s[j]
                j -= 1
            k = seed + 1
            while k < n and (total < most or (total < most + grace and not ending[members].any())):
                if used[k]:
                    k += 1
                    continue
                if total < most:
                    ok = ending[k] or active[max(0, k - 1):k + 2].any() or sim(members[-1], k) >= like
                else:
                    first, last = members[0], members[-1]
                    ok = ending[k] or (chapter[k] == chapter[first] and sim(last, k) >= like)
                    if not ok:
                        stop = next((q for q in range(k, n) if chapter[q] != chapter[first] or e[q] - s[last] > total + grace + 1 or s[q] - e[last] > ahead), n)
                        bridge = next((q for q in range(k, stop) if ending[q]), None)
                        if bridge is not None:
                            members += range(k, bridge + 1)
                            total += float((e[k:bridge + 1] - s[k:bridge + 1]).sum())
                            k = bridge + 1
                            continue
                if not ok:
                    break
                members.append(int(k))
                total += e[k] - s[k]
                k += 1
            if total >= max(0.65 * least, least - 60):
                used |= (s >= s[members[0]]) & (e <= e[members[-1]])
                out.append({**{c: r[c].iloc[0] for c in keys}, "start": s[members[0]], "end": e[members[-1]], "n": len(members), "total": total,
                            "members": r["id"].iloc[members].tolist()})
        return pd.DataFrame(out, columns=[*keys, "start", "end", "n", "total", "members"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", start double, end double, n long, total double, members array<{kinds['id']}>"
    cols = list(dict.fromkeys([*keys, "id", "start", "end", "topic", "chapter", "role", "energy", "avg_z", "vector"]))
    return df.select(*cols).groupBy(*keys).applyInPandas(run, schema)


def merge_boxes(df: DataFrame, keys: list[str], iou: float = 0.1) -> DataFrame:
    """The largest box after boxes that overlap by more than ``iou`` are united, largest first."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = sorted(([r.x, r.y, r.x + r.w, r.y + r.h] for r in pdf.itertuples()), key=lambda b: (-(b[2] - b[0]) * (b[3] - b[1]), b))
        kept: list[list[float]] = []
        for b in boxes:
            for m in kept:
                w, h = min(b[2], m[2]) - max(b[0], m[0]), min(b[3], m[3]) - max(b[1], m[1])
                shared = max(0, w) * max(0, h)
                if shared > iou * ((b[2] - b[0]) * (b[3] - b[1]) + (m[2] - m[0]) * (m[3] - m[1]) - shared):
                    m[:] = [min(b[0], m[0]), min(b[1], m[1]), max(b[2], m[2]), max(b[3], m[3])]
                    break
            else:
                kept.append(list(b))
        best = max(kept, key=lambda b: (b[2] - b[0]) * (b[3] - b[1]))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "x": best[0], "y": best[1], "w": best[2] - best[0], "h": best[3] - best[1]}])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", x double, y double, w double, h double"
    return df.select(*keys, *[df[c].cast("double") for c in ("x", "y", "w", "h")]).groupBy(*keys).applyInPandas(run, schema)
