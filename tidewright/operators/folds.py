"""Sequential packing: each decision depends on those before it, within one ordered group."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import subtitle_time


def carried(df: DataFrame, group: str, order: list[str], schema: str, start: Callable[[], object], feed: Callable[[object, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Rows of each group in order, in Arrow batches, with a state carried from batch to batch: ``feed(state, rows)`` gives the rows
    that come out. A task holds one batch and one state, however large the group; the null group is a group."""
    sorted_ = df.repartition(group).sortWithinPartitions(group, *order)

    def run(batches):
        key, state, begun = None, None, False
        for p in batches:
            keys = p[group]
            new = keys.ne(keys.shift()) & ~(keys.isna() & keys.shift().isna())
            cuts = [*new.to_numpy().nonzero()[0].tolist(), len(p)]
            for i, j in zip(sorted({0, *cuts[:-1]}), [*sorted({0, *cuts[:-1]})[1:], len(p)]):
                k = keys.iloc[i] if i < len(p) else None
                if not begun or not (k == key or (pd.isna(k) and pd.isna(key))):
                    key, state, begun = k, start(), True
                if i < j:
                    yield feed(state, p.iloc[i:j])

    return sorted_.mapInPandas(run, schema)


def pack_cues(df: DataFrame, group: str, order: list[str], word: str, max_words: int, max_chars: int) -> DataFrame:
    """Adds ``cue``: words go greedily into cues of limited words and of limited characters with a space after each word."""

    def feed(state, p):
        out = []
        for w in p[word]:
            n = len(w or "")
            if state["words"] and state["words"] < max_words and state["chars"] + n <= max_chars:
                state["words"] += 1
                state["chars"] += n + 1
            else:
                state.update(cue=state["cue"] + 1, words=1, chars=n + 1)
            out.append(state["cue"])
        return p.assign(cue=out)

    return carried(df, group, order, _with(df, "cue int"), lambda: {"cue": 0, "words": 0, "chars": 0}, feed)


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def phrase_cues(tokens: list[str], hard: str = "。！？!?；;", soft: str = "，,、：:", most: int = 18, short: int = 5, orphan: int = 3) -> list[str]:
    """Phrases: cut at hard marks, long ones cut at soft marks or where full, short neighbours joined, orphans merged back."""
    phrases, now = [], ""
    for t in tokens:
        now += t
        if t and t[-1] in hard:
            phrases.append(now)
            now = ""
    if now:
        phrases.append(now)
    cut: list[str] = []
    for p in phrases:
        while len(p) > most:
            at = max((i + 1 for i in range(most) if p[i] in soft), default=most)
            cut.append(p[:at])
            p = p[at:]
        if p:
            cut.append(p)
    joined: list[str] = []
    for p in cut:
        if joined and len(joined[-1]) < short and len(joined[-1]) + len(p) <= most and joined[-1][-1] not in hard:
            joined[-1] += p
        elif joined and len(p) <= orphan:
            joined[-1] += p
        else:
            joined.append(p)
    return joined


def pages(df: DataFrame, group: str, order: list[str], height: str, capacity: int) -> DataFrame:
    """Adds ``page``: items in order, a new page where the next doesn't fit what is left of one."""

    def feed(state, p):
        out = []
        for h in p[height].tolist():
            if state["used"] and state["used"] + h > capacity:
                state.update(page=state["page"] + 1, used=0)
            state["used"] += h
            out.append(state["page"])
        return p.assign(page=out)

    return carried(df, group, order, _with(df, "page int"), lambda: {"page": 0, "used": 0}, feed)


def grid_height(heights: Column, columns: int = 2, gap: int = 8) -> Column:
    """Height of a grid: the rows' greatest heights and the gaps between rows."""
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(heights) / columns).cast("int") - 1)), lambda r: F.array_max(F.slice(heights, r * columns + 1, F.lit(columns))))
    return F.aggregate(rows, F.lit(0).cast("long"), lambda s, h: s + F.coalesce(h, F.lit(0))) + gap * F.greatest(F.lit(0), F.size(rows) - 1)


def closure(words: Column, clusters: list[list[str]]) -> Column:
    """Synonyms of a word set: clusters in order, each that meets the set so far joins it whole."""
    out = words
    for c in clusters:
        members = F.array(*map(F.lit, c))
        out = F.when(F.arrays_overlap(out, members), F.array_union(out, members)).otherwise(out)
    return out


def subtitles(df: DataFrame, group: str, order: str, start: str, end: str, text: str, form: str) -> DataFrame:
    """``group, srt`` or ``group, vtt``: the group's cues as one subtitle file, which is what a file is made of."""
    mark = "," if form == "srt" else "."
    cue = F.concat(subtitle_time(F.col(start), mark), F.lit(" --> "), subtitle_time(F.col(end), mark), F.lit("\n"), F.col(text))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), cue.alias("cue"))))
    cues = F.transform(listed, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["cue"]) if form == "srt" else x["cue"])
    head = "" if form == "srt" else "WEBVTT\n\n"
    return df.groupBy(group).agg(F.concat(F.lit(head), F.array_join(cues, "\n\n")).alias(form))
