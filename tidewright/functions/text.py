"""Text scalars. Native expressions where they can say it; Arrow-batched Python only for what depends on the text so far."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def collapse(x: Column) -> Column:
    """Runs of any white space, the ideographic space too, as one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)[\s　]+", " "))


def squeezed(x: Column) -> Column:
    """Without white space, in lower case."""
    return F.lower(F.regexp_replace(x, r"(?U)[\s　]+", ""))


def ungrouped(x: Column) -> Column:
    """Numbers without separators between groups of three digits."""
    first = r"(?<![0-9])(?=[0-9]{1,3}(?:[,，][0-9]{3})+(?![0-9]))[0-9]{1,3}"  # where a grouped number begins
    return F.regexp_replace(x, rf"({first}|\G(?<=[,，])[0-9]{{3}})[,，](?=[0-9]{{3}}(?![0-9]))", "$1")


def visible_units(x: Column) -> Column:
    """Characters that aren't white space, numbers taken without their separators."""
    return F.length(F.regexp_replace(ungrouped(collapse(x)), r"(?U)\s", ""))


def sentences(x: Column) -> Column:
    """Parts up to and with a final mark, and what remains, trimmed."""
    parts = F.regexp_extract_all(x, F.lit(r"[^。！？!?；;]+[。！？!?；;]?"), F.lit(0))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def tokens(x: Column) -> Column:
    """Lower-case words of letters and digits with + . _ - inside."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9](?:[a-z0-9+._-]*[a-z0-9])?"), F.lit(0))


def words(x: Column) -> Column:
    """Words of a transcript: letters, digits, hyphen and apostrophe kept."""
    return F.filter(F.split(F.regexp_replace(F.lower(x), r"[^a-z0-9'\- ]", " "), " +"), lambda t: t != "")


def claims(x: Column) -> Column:
    """Distinct Latin words, and numbers with a unit next to them."""
    return F.array_distinct(F.array_union(F.regexp_extract_all(x, F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0)), F.regexp_extract_all(x, F.lit(r"[0-9]+(?:\.[0-9]+)?[%KMB]?"), F.lit(0))))


def unsupported(text: Column, evidence: Column) -> Column:
    return F.array_sort(F.array_except(claims(text), claims(evidence)))


def copied(text: Column, source: Column, least: int = 18) -> Column:
    """Whether a text, without marks and white space, equals its source or is a long part of it."""
    core = lambda c: F.regexp_replace(c, r"(?U)[\s\p{Punct}，。！？；：、（）【】《》“”‘’…—]+", "")
    return (core(text) == core(source)) | ((F.length(core(text)) >= least) & core(source).contains(core(text)))


def missing_tokens(required: Column, text: Column) -> Column:
    """Sorted distinct required words that don't stand alone in the text."""
    alone = lambda t: F.regexp_like(text, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), t, F.lit(r"\E(?![A-Za-z0-9])")))
    return F.array_sort(F.array_distinct(F.filter(required, lambda t: ~alone(t))))


def width_units(x: Column) -> Column:
    """Width in wide characters: those from U+2E80 count 1, others 0.56, white space nothing."""
    bare = F.regexp_replace(x, r"(?U)\s", "")
    wide = F.length(F.regexp_replace(bare, r"[^⺀-\x{10FFFF}]", ""))
    return wide + 0.56 * (F.length(bare) - wide)


def clauses(x: Column, most: int = 5) -> Column:
    """Distinct clauses, those with digits first, ``most`` at most."""
    parts = F.array_distinct(F.filter(F.transform(F.split(x, "[，,。；;]"), lambda p: F.trim(p)), lambda p: p != ""))
    return F.slice(F.concat(F.filter(parts, lambda p: p.rlike("[0-9]")), F.filter(parts, lambda p: ~p.rlike("[0-9]"))), 1, most)


def has_phrase(x: Column, phrases: list[str]) -> Column:
    low = F.lower(x)
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: low.contains(p))


def plain_dashes(x: Column) -> Column:
    return F.translate(x, "‐‑‒–—―−", "-------")


def layered(*parts: Column) -> Column:
    """Non-blank parts as one text, joined by '. '."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")), ". ")


def ordered_case(x: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule whose fragment (all of several joined by +) stands in the text."""
    low, out = F.lower(x), None
    for fragment, name in rules:
        first, *more = fragment.split("+")
        cond = low.contains(first)
        for x in more:
            cond = cond & low.contains(x)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(other)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def video_id(x: Column) -> Column:
    """An address's id of eleven characters; what is such an id already, or has none, stays."""
    found = F.regexp_extract(x, r"(?:youtube\.com/watch\?.*v=|youtu\.be/|youtube\.com/embed/|youtube\.com/shorts/)([A-Za-z0-9_-]{11})", 1)
    return F.when(x.rlike("^[A-Za-z0-9_-]{11}$"), x).otherwise(F.coalesce(F.nullif(found, F.lit("")), F.trim(x)))


def without_addresses(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"https?://[^\s]+", ""), r"\s+", " "))


def has_markup(x: Column) -> Column:
    return F.lower(x).contains("<script") | F.lower(x).contains("javascript:")


def escapes(path: Column) -> Column:
    """Whether a path leaves its folder."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def slug_tags(address: Column) -> Column:
    """Words of an address's last part, numbers left out."""
    last = F.lower(F.regexp_extract(F.rtrim(address, F.lit("/")), "([^/]*)$", 1))
    return F.filter(F.split(last, "[-_.?=&]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))


def year_token(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, "(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit("")).cast("int")


def license_class(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.contains("cc0") | low.contains("public"), "public").when(low.contains("cc"), "attribution").when(x.isNull() | (F.trim(x) == ""), "unknown").otherwise("other")


def search_terms(x: Column, stop: list[str], n: int = 3) -> Column:
    """The n longest words of at least three letters that aren't stop words; the earlier wins ties."""
    kept = F.filter(tokens(x), lambda t: (F.length(t) >= 3) & ~t.isin(stop))
    keyed = F.array_sort(F.transform(kept, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.transform(F.slice(keyed, 1, n), lambda s: s["t"])


def corrected(x: Column, fixes: dict[str, str]) -> Column:
    """Words replaced by a dictionary without regard to case, the marks after a word kept."""
    table = F.create_map(*(F.lit(v) for kv in fixes.items() for v in kv))
    bare = lambda w: F.rtrim(w, F.lit(".,!?;:"))
    fix = lambda w: F.coalesce(F.concat(F.try_element_at(table, F.lower(bare(w))), F.substring(w, F.length(bare(w)) + 1, F.length(w))), w)
    return F.array_join(F.transform(F.split(x, " "), fix), " ")


def fragments(title: Column, summary: Column, most_chars: int = 155, most: int = 3) -> Column:
    """Title and summary sentences, each once (without regard to spaces and final marks), as many in order as fit with one
    character between them; the first always."""
    key = lambda p: F.regexp_replace(F.regexp_replace(p, r"[。！？!?；;\s]+$", ""), " ", "")
    parts = F.concat(F.array(F.trim(F.coalesce(title, F.lit("")))), F.coalesce(sentences(summary), F.array().cast("array<string>")))
    keyed = F.transform(parts, lambda p: F.struct(key(p).alias("k"), p.alias("p")))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        used = s["used"] + F.length(x["p"]) + F.when(s["used"] > 0, 1).otherwise(0)
        over = (s["used"] > 0) & (used > most_chars)
        taken = F.struct(used.alias("used"), (F.size(s["out"]) + 1 >= most).alias("full"), F.array_append(s["keys"], x["k"]).alias("keys"), F.array_append(s["out"], x["p"]).alias("out"))
        closed = F.struct(s["used"].alias("used"), F.lit(True).alias("full"), s["keys"].alias("keys"), s["out"].alias("out"))
        return F.when(s["full"] | (x["k"] == "") | F.array_contains(s["keys"], x["k"]), s).when(over, closed).otherwise(taken)

    return F.aggregate(keyed, start, step, lambda s: s["out"])


def label_base(title: Column, width: int = 16) -> Column:
    """A title's first word or phrase, or what the title begins with."""
    word = F.nullif(F.regexp_extract(title, "[A-Za-z][A-Za-z0-9.+-]*|[一-鿿]+", 0), F.lit(""))
    return F.left(F.coalesce(word, F.nullif(F.trim(title), F.lit("")), F.lit("item")), F.lit(width))


# --- what depends on the text so far ---------------------------------------------------------------------------

#: Marks a caption may break after (fixed values).
_SOFT = "，、：；,;:）)"


def caption_units(text: str, most: int) -> list[str]:
    """Stretches of at most ``most`` visible characters: a search over the counts of visible characters before each place says
    how much fits, one over the soft marks and spaces where in its second half to break last. Together they are the sentences."""
    out = []
    for sentence in re.findall(r"[^。！？!?；;]+[。！？!?；;]?", text):
        s = sentence.strip()
        blank = np.fromiter(map(str.isspace, s), bool, len(s))
        seen = np.r_[0, np.cumsum(~blank)]
        breaks = np.flatnonzero(blank | np.fromiter((c in _SOFT for c in s), bool, len(s))) + 1
        at = 0
        while at < len(s):
            end = int(np.searchsorted(seen, seen[at] + most, "right")) - 1
            if end < len(s):
                end = max(end, at + 1)
                b = int(np.searchsorted(breaks, end, "right")) - 1
                if b >= 0 and breaks[b] >= at + max(1, (end - at) // 2):
                    end = int(breaks[b])
            out.append(s[at:end])
            at = end
    return [u for u in out if u.strip()]


@pandas_udf(T.ArrayType(T.StringType()))
def caption_units_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda s: caption_units(s, 28) if s else [])


DIGITS = "零一二三四五六七八九"


def spoken_integer(n: int) -> str:
    """A whole number read in Chinese."""
    if n < 0:
        return "负" + spoken_integer(-n)
    if n < 10:
        return DIGITS[n]

    def below_myriad(x: int) -> str:
        text, gap = "", False
        for unit, name in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
            d, x = divmod(x, unit)
            if d:
                text += ("零" if gap and text else "") + DIGITS[d] + name
                gap = False
            else:
                gap = True
        return text

    text, gap = "", False
    for power, name in ((16, "京"), (12, "兆"), (8, "亿"), (4, "万"), (0, "")):
        part, n = divmod(n, 10**power)
        if part:
            text += ("零" if text and (gap or part < 1000) else "") + below_myriad(part) + name
            gap = False
        elif text:
            gap = True
    return text[1:] if text.startswith("一十") else text


_NUMERAL = re.compile(r"\s*(?P<minus>-?)(?P<whole>[0-9][0-9,，]{0,25})(?:\.(?P<part>[0-9]+))?\s*")
_READ = str.maketrans("0123456789", DIGITS)


def spoken_number(written: str, zeros: int = 0) -> str:
    """A written number, with so many zeros more, read in Chinese, its decimals digit by digit; what isn't a number stays."""
    m = _NUMERAL.fullmatch(written)
    if not m:
        return written
    part = (m["part"] or "").ljust(zeros, "0")
    whole = re.sub("[,，]", "", m["whole"]) + part[:zeros]
    part = part[zeros:].rstrip("0") if zeros else part
    return ("负" if m["minus"] else "") + spoken_integer(int(whole)) + ("点" + part.translate(_READ) if part else "")


# Kinds, patterns and readings of the rewrites, in the order in which they are applied.
_N = r"(?<![A-Za-z0-9])([0-9][0-9,，]*(?:\.[0-9]+)?)"
_PLAIN = r"(?<![A-Za-z0-9])([0-9]+(?:\.[0-9]+)?)"
BYTES = {"K": "千字节", "M": "兆字节", "G": "吉字节", "T": "太字节"}
COUNTED = "位|项|名|个|家|页|类|条|种|款|倍|分钟|分|秒|月|日|年|%|％|亿美元|美元|亿元|万元"
WORDS_KEPT = frozenset(["AI", "API"])
RULES = (
    ("rate", re.compile(_N + r"\s*tokens?\s*/\s*s\b", re.I), lambda m: f"每秒{spoken_number(m[1])}个 token"),
    ("storage_unit", re.compile(_N + r"\s*([KMGT])i?B\b", re.I), lambda m: spoken_number(m[1]) + BYTES[m[2].upper()]),
    ("billion_unit", re.compile(_PLAIN + r"\s*(?:bn|billion|B)\b"), lambda m: spoken_number(m[1], 9)),
    ("million_unit", re.compile(_PLAIN + r"\s*(?:mn|million|M)\b"), lambda m: spoken_number(m[1], 6)),
    ("thousand_unit", re.compile(_PLAIN + r"\s*[Kk]\b"), lambda m: spoken_number(m[1], 3)),
    ("token_count", re.compile(_N + r"\s*tokens?\b", re.I), lambda m: f"{spoken_number(m[1])}个 token"),
    ("count_or_measure", re.compile(_N + rf"\s*({COUNTED})(?![A-Za-z])"), lambda m: "百分之" + spoken_number(m[1]) if m[2] in "%％" else spoken_number(m[1]) + m[2]),
    ("hyphenated_model_version", re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2,})-([0-9]+(?:\.[0-9]+)?)([A-Za-z]*)\b"), lambda m: " ".join([m[1], spoken_number(m[2]), *m[3]])),
    ("mixed_model_version", re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2,})([0-9]+(?:\.[0-9]+)?)(?![A-Za-z0-9])"), lambda m: f"{m[1]} {spoken_number(m[2])}"),
    ("quantization_code", re.compile(r"(?<![A-Za-z0-9])([A-Za-z])([0-9]+)((?:_[A-Za-z0-9]+)+)\b"), lambda m: f"{m[1].upper()} {spoken_number(m[2])}" + m[3].replace("_", " ")),
    ("compound_code", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2,6}(?:[-_][A-Z0-9]{1,8})+\b"), lambda m: re.sub("[-_]", " ", m[0])),
    ("locale_code", re.compile(r"(?<![A-Za-z])([a-z]{2})-([A-Z]{2})(?![A-Za-z])"), lambda m: f"{m[1]} {m[2]}"),
    ("slash_code", re.compile(r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9]*)/([A-Za-z][A-Za-z0-9]*)\b"), lambda m: f"{m[1]} 每 {m[2]}"),
    ("plain_number", re.compile(_N + r"(?![A-Za-z0-9])"), lambda m: spoken_number(m[1])),
    ("acronym", re.compile(r"(?<![A-Za-z])[A-Z]{2,5}(?![A-Za-z])"), lambda m: m[0] if m[0] in WORDS_KEPT else " ".join(m[0])),
)
_GROUPED = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,3}(?:[,，][0-9]{3})+(?![0-9])")


def rewritten(text: str) -> tuple[str, list[dict]]:
    """The text as spoken, and a ledger of rewrites; a rewrite's place refers to the text its rule was applied to."""
    ledger: list[dict] = []

    def apply(text: str, kind: str, pattern: re.Pattern, read) -> str:
        done, at = [], 0
        for m in pattern.finditer(text):
            new = read(m)
            done += [text[at : m.start()], new]
            at = m.end()
            if new != m[0]:
                ledger.append({"kind": kind, "source": m[0], "reading": new, "start": m.start(), "stop": m.end()})
        return "".join([*done, text[at:]])

    text = apply(text, "display_number_separator", _GROUPED, lambda m: re.sub("[,，]", "", m[0]))
    for rule in RULES:
        text = apply(text, *rule)
    text = re.sub(r"\s+(?=[，。！？；：,.!?;:])", "", text)
    text = re.sub(r"[，。！？；：,.!?;:]+(?=[，。！？；：,.!?;:])", "", text)  # of marks in a row the last
    return " ".join(text.split()), ledger


_LEDGER = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("source", T.StringType()), T.StructField("reading", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


@pandas_udf(T.StructType([T.StructField("spoken", T.StringType()), T.StructField("rewrites", _LEDGER)]))
def rewritten_udf(text: pd.Series) -> pd.DataFrame:
    got = [rewritten(s or "") for s in text]
    return pd.DataFrame({"spoken": [s for s, _ in got], "rewrites": [r for _, r in got]})
