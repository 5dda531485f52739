"""One form for texts that look alike (problem 5, and the text forms of problems 1 to 4 and 7).

Method: look-alike *classes* are built by union-find over strings and code points, so that the relation is
transitive (a Cyrillic letter with a combining accent meets the composed Latin letter through both its parts);
every class gets the member most frequent in a corpus as representative; texts are rewritten greedily,
leftmost-longest, by one Aho-Corasick automaton over all class members.

Letter case, accents, simplified or traditional Han, raised digits and other punctuation are *not* merged.
Null stays null. A text without a rewritable character is returned as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping
from functools import lru_cache

import ahocorasick

# --- Fixed values: letters of other scripts drawn like a Latin letter ------------------------------------
LOOKALIKE_LETTERS = (
    # Cyrillic
    "аa еe оo рp сc уy хx ѕs іi јj һh ӏl ԁd ԛq ԝw ѵv АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ ӀI ԚQ ԜW УY ҮY ѴV "
    # Greek
    "οo ϲc ϳj αa γy ιi νv ρp υu ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "
    # Armenian
    "օo սu հh ոn ցg զq յj ՕO ՍU ՏS "
    # Cherokee
    "ᎠD ᎡR ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB "
    # Coptic
    "ⲎH ⲒI ⲚN ⲞO ⲟo ⲢP ⲤC ⲥc ⲔK ⲘM ⲦT ⲬX "
    # Lisu
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    # Latin letters of phonetic alphabets, small capitals
    "ɡg ᴄc ᴏo ᴠv ᴡw ᴢz ꜱs"
)
# --- Fixed values: radicals of the CJK supplement and the Han characters of the same shape ----------------
RADICAL_SUPPLEMENT = (
    "⺁厂 ⺄乚 ⺅亻 ⺆冂 ⺉刂 ⺋㔾 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺗㣺 ⺘扌 ⺙攵 ⺛旡 ⺟母 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺦丬 "
    "⺨犭 ⺫罒 ⺭礻 ⺯糹 ⺰纟 ⺱罓 ⺹耂 ⺾艹 ⻁虎 ⻂衤 ⻅见 ⻆角 ⻈讠 ⻉贝 ⻋车 ⻌辶 ⻐钅 ⻑長 ⻓长 ⻔门 ⻖阝 ⻘青 ⻙韦 "
    "⻚页 ⻛风 ⻜飞 ⻝食 ⻠饣 ⻢马 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻳龟"
)
# --- Fixed values: kinds of hyphen; white space drawn as one space besides category Zs; blank fillers --------
HYPHENS = "-‐‑‒–⁃−˗﹣－"
SPACES = "\t "
BLANK_FILLERS = "͏ᅟᅠ឴឵ㅤﾠ"


class UnionFind:
    """Disjoint sets over hashable members, with path halving."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in out.values() if len(v) > 1]


def _assigned() -> Iterable[int]:
    """Code points of the planes in use (up to the Han extensions, and the tags), so that tables are quick to make."""
    return (*range(0x32400), *range(0xE0000, 0xE0200))


def _is_han(ch: str) -> bool:
    o = ord(ch)
    return 0x3400 <= o <= 0x9FFF or 0x20000 <= o <= 0x3FFFF


@lru_cache(1)
def invisible() -> frozenset[str]:
    """Characters that show nothing: format characters, controls other than white space, variation selectors, fillers."""
    out = set(BLANK_FILLERS)
    for o in _assigned():
        c = chr(o)
        kind = unicodedata.category(c)
        if kind == "Cf" or kind == "Cc" and not c.isspace() or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
            out.add(c)
    return frozenset(out)


@lru_cache(1)
def base_pairs() -> tuple[tuple[str, str], ...]:
    """The pairs of strings that look alike, from Unicode's own decompositions and the fixed values above."""
    pairs = [(x[0], x[1]) for x in LOOKALIKE_LETTERS.split()] + [(x[0], x[1]) for x in RADICAL_SUPPLEMENT.split()]
    pairs += [(c, "-") for c in HYPHENS] + [(c, " ") for c in SPACES]
    for o in _assigned():
        if 0xAC00 <= o <= 0xD7A3 or 0xD800 <= o <= 0xDFFF:
            continue
        c = chr(o)
        if unicodedata.category(c) == "Zs":
            pairs.append((c, " "))
        how = unicodedata.decomposition(c)
        if not how:
            continue
        kind, _, rest = how.partition(" ") if how[0] == "<" else ("", "", how)
        to = "".join(chr(int(x, 16)) for x in rest.split())
        roman = 0x2160 <= o <= 0x217F and len(to) == 1  # numerals drawn as one letter
        if roman or kind in ("<wide>", "<narrow>") or kind == "" or kind == "<compat>" and len(to) == 1 and _is_han(to):
            pairs.append((c, to))
            if kind == "" and (full := unicodedata.normalize("NFD", c)) != to:
                pairs.append((c, full))
    return tuple((a, b) for a, b in pairs if a != b)


def classes_of(pairs: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Transitive classes: single characters first, then strings, each also joined to what it becomes part by part."""
    uf = UnionFind()
    strings = []
    for a, b in pairs:
        if len(a) == 1 and len(b) == 1:
            uf.union(a, b)
        else:
            strings.append((a, b))
    for a, b in strings:
        uf.union(a, b)
        uf.union(b, "".join(uf.find(c) for c in b))
    return uf.classes()


def _plainness(m: str) -> tuple:
    """Sort key by which the plainest spelling of a class comes first."""
    return (not m.isascii(), any(unicodedata.category(c) == "Cc" for c in m), unicodedata.normalize("NFKC", m) != m, not m.isalnum(), len(m), m)


class LookFolder:
    """Rewrites texts to one form. ``counts`` (member -> occurrences in a corpus) chooses each class's representative:
    its most frequent member; without counts, and in ties, its plainest (ASCII, composed, ordinary) spelling."""

    def __init__(self, counts: Mapping[str, int] | None = None, pairs: Iterable[tuple[str, str]] | None = None) -> None:
        counts = counts or {}
        self.table: dict[str, str] = {}  # member -> plainest member of its class
        self.representative: dict[str, str] = {}  # plainest -> most frequent
        for members in classes_of(base_pairs() if pairs is None else pairs):
            plain = min(members, key=_plainness)
            self.table.update((m, plain) for m in members if m != plain)
            rep = min(members, key=lambda m: (-counts.get(m, 0), *_plainness(m)))
            if rep != plain:
                self.representative[plain] = rep
        self.automaton, self.last = _automaton(self.table), _automaton(self.representative)
        gone = invisible()
        self.gone = {ord(c): None for c in gone}
        self.marks = {c for c in map(chr, _assigned()) if unicodedata.combining(c) or "\u1100" <= c <= "\u11ff"}
        self.risky = {m for m in (*self.table, *self.representative) if len(m) == 1} | gone | self.marks

    def look(self, s: str | None) -> str | None:
        """The text's one form. Greedy leftmost-longest; accents are composed between the two passes, since a base
        letter may itself have been a look-alike."""
        if not s or self.risky.isdisjoint(s):
            return s
        s = _rewrite(self.automaton, s.translate(self.gone))
        if not self.marks.isdisjoint(s):
            s = _rewrite(self.automaton, unicodedata.normalize("NFC", s))
        return _rewrite(self.last, s)


def _automaton(table: Mapping[str, str]) -> ahocorasick.Automaton | None:
    if not table:
        return None
    out = ahocorasick.Automaton()
    for m, rep in table.items():
        out.add_word(m, (len(m), rep))
    out.make_automaton()
    return out


def _rewrite(automaton: ahocorasick.Automaton | None, s: str) -> str:
    if automaton is None:
        return s
    out, at = [], 0
    for end, (n, rep) in automaton.iter_long(s):
        out.append(s[at : end + 1 - n])
        out.append(rep)
        at = end + 1
    return "".join(out) + s[at:] if out else s


@lru_cache(1)
def folder() -> LookFolder:
    """The folder with Latin, ordinary-width representatives, made once a process."""
    return LookFolder()


_NOT_ALNUM = re.compile(r"[\W_]+")
_SPACE = re.compile(r"\s+")


def look(s: str | None) -> str | None:
    return folder().look(s)


@lru_cache(1)
def lowered_first() -> dict[int, str]:
    """Capitals that aren't drawn like the capital of the Latin letter their lower case is drawn like: a text in look-alike letters
    and then in capitals holds them, so the bare form takes their lower case. (The palochka is drawn like I in both cases, but where it stands for a letter it
    is the l of its lower case.)"""
    f, out = folder(), {}
    for o in _assigned():
        c = chr(o)
        low = c.lower()
        if len(low) == 1 and low != c and not low.isascii() and f.look(low).isascii() and (c == "Ӏ" or not f.look(c).isascii()):
            out[o] = low
    return out


def bare(s: str | None) -> str:
    """The look in lower case with only letters and digits kept; '' for null and blank texts."""
    return _NOT_ALNUM.sub("", folder().look(s.translate(lowered_first())).lower()) if s else ""


def name_key(s: str | None) -> str | None:
    """The look without regard to letter case and white space; null for a missing or blank name."""
    if s is None:
        return None
    return _SPACE.sub("", folder().look(s)).lower() or None


def category_key(s: str | None) -> str:
    """The look without regard to case, outer white space, and hyphen, underscore or space between words; blank: 'other'."""
    x = folder().look(s).strip().lower() if s else ""
    return re.sub(r"[-_\s]+", "", x) or "other"
