"""Text decoded with the wrong character set: found and, where it survives, restored.

A hidden Markov model with one clean state and one state per pair (right, wrong) of character sets
labels every character of a text. Emissions are character bigrams, counted over all distinct texts
of the corpus itself: the clean state on the texts, each other state on what its pair makes of them.
A second round counts without the texts that the first one labelled. Every labelled span then gets
the inverse transform of its state.
"""

from __future__ import annotations

import codecs
import math
import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.session import cut_lineage

#: Uses in all texts and what the pairs make of them from which a character is a symbol of its own; all such are kept.
SYMBOL_USES = 4
#: Prior of a text that is not clean, and of a change of state between two characters.
START_WRONG, CHANGE = 0.06, 1e-4
ROUNDS = 2
#: Bigrams whose emissions a worker remembers.
EMISSIONS = 30_000
#: Counts of (state, bigram) that a worker gathers before it passes them on.
GATHERED = 500_000

#: Pairs of character sets, as (right, those it is mistaken for).
_WESTERN = ("latin-1", "cp1252", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "cp437", "mac_roman")
PAIRS = (
    ("utf-8", (*_WESTERN, "cp1250", "cp1251", "cp932", "gbk", "cp949")),
    ("latin-1", ("iso8859-2", "iso8859-5", "iso8859-7", "cp1251", "cp437", "mac_roman", "gbk", "cp949", "cp932", "utf-8")),
    ("iso8859-2", ("latin-1", "iso8859-5", "iso8859-7", "cp437", "mac_roman", "gbk", "utf-8")),
    ("iso8859-5", ("latin-1", "iso8859-2", "iso8859-7", "iso8859-9", "cp437", "mac_roman", "cp1251", "koi8-r", "gbk", "utf-8")),
    ("iso8859-7", ("latin-1", "iso8859-2", "iso8859-5", "iso8859-9", "cp437", "mac_roman", "gbk", "utf-8")),
    ("cp1251", ("latin-1", "koi8-r", "iso8859-5", "utf-8")),
    ("koi8-r", ("latin-1", "cp1251", "iso8859-5", "utf-8")),
    ("cp437", ("latin-1", "cp1252")),
    ("gb18030", (*_WESTERN, "cp949", "cp932", "utf-8")),
    ("cp949", (*_WESTERN, "gbk", "cp932", "utf-8")),
    ("shift_jis", (*_WESTERN, "gbk", "cp949", "utf-8")),
    ("euc_jp", (*_WESTERN, "gbk", "cp949", "utf-8")),
)
_WIDE = {"gbk", "cp949", "cp932", "utf-8", "gb18030", "shift_jis", "euc_jp"}
_ESCAPED = re.compile(r"\x1b?(\$[@B]|\([BJI])")


@lru_cache(64)
def _table(codec: str) -> tuple[str, dict[str, int]]:
    """A one-byte set as 256 characters (undefined bytes stand for themselves), and the way back."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back = {chr(b): b for b in range(256)}
    back.update({c: b for b, c in enumerate(chars)})
    return "".join(chars), back


def to_bytes(text: str, wrong: str) -> bytes | None:
    """The bytes behind a text that was decoded with `wrong`; undefined bytes stood for themselves."""
    if wrong in _WIDE:
        try:
            return text.encode(wrong)
        except UnicodeEncodeError:
            return None
    try:
        return bytes(map(_table(wrong)[1].__getitem__, text))
    except KeyError:
        return None


def from_bytes(data: bytes, wrong: str) -> str:
    """Bytes read with `wrong`; bytes that it doesn't define stand for themselves."""
    if wrong in _WIDE:
        return data.decode(wrong, "replace")
    return codecs.charmap_decode(data, "strict", _table(wrong)[0])[0]


def states() -> list[tuple[str, str]]:
    """(right, wrong) of every state but the clean one, which is state 0."""
    pairs = [(r, w) for r, ws in PAIRS for w in ws]
    return [*pairs, ("utf-8*2", "latin-1"), ("utf-8*2", "cp1252"), ("iso2022_jp", "escape"), ("iso2022_jp", "no escape"), ("lost", "?"), ("lost", "�")]


_IDEOGRAPH, _OTHER, _CONTROLS = re.compile("[\u2e80-\ud7af]"), re.compile("[^\x00-\x7f]"), re.compile("[\x80-\x9f]")


def damage(text: str, right: str, wrong: str) -> str | None:
    """What a text becomes; None where the pair can't hold it."""
    if right in _EASTERN and not _IDEOGRAPH.search(text):
        return None
    try:
        if right == "lost":
            return _OTHER.sub(wrong, text)
        if right == "utf-8*2":
            return damage(damage(text, "utf-8", wrong) or "", "utf-8", wrong)
        if right == "iso2022_jp":
            t = text.encode("iso2022_jp").decode("latin-1")
            return t if wrong == "escape" else t.replace("\x1b", "")
        return from_bytes(text.encode(right), wrong)
    except UnicodeEncodeError:
        return None


def restore(text: str, right: str, wrong: str) -> str | None:
    """The inverse of `damage`; None where the original does not survive."""
    if right == "lost" or "�" in text:
        return None
    if right == "utf-8*2":
        once = restore(text, "utf-8", wrong)
        return None if once is None else restore(once, "utf-8", wrong)
    try:
        if right == "iso2022_jp":
            return _ESCAPED.sub(lambda m: "\x1b" + m[1], text).encode("latin-1").decode("iso2022_jp")
        data = to_bytes(text, wrong)
        return None if data is None else data.decode(right)
    except UnicodeError:
        return None


#: Letters of other scripts that stand in for Latin ones; a clean text may hold them.
_LOOK_CYRILLIC, _LOOK_GREEK = frozenset("аеорсухіѕјԁһАВЕКМНОРСТХІЅЈУҮӧ"), frozenset("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικρυ")
_READ_AS = str.maketrans("аеорсухіѕјԁһАВЕКМНОРСТХІЅЈУΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικρυ‐‑‒–", "aeopcyxisjdhABEKMHOPCTXISJYABEZHIKMNOPTYXovikpu----")
#: Right character sets that only East Asian text was written in.
_EASTERN = {"gb18030", "cp949", "shift_jis", "euc_jp", "iso2022_jp"}
#: How much better (log probability) the restored text must read than the text as it stands, or the
#: labelled path than the clean one where the original does not survive.
MARGIN = 6.0
#: Signs that names hold besides letters and marks.
_SIGNS = frozenset(" ^=-'.,＾＇－")
#: A Latin letter beside a Greek or Cyrillic one that doesn't look like any.
_LATIN, _UNLIKE = "[A-Za-z\u00c0-\u024f]", f"(?![{''.join(sorted(_LOOK_CYRILLIC | _LOOK_GREEK))}])[\u0370-\u052f]"
_MIXED = re.compile(f"{_LATIN}{_UNLIKE}|{_UNLIKE}{_LATIN}")
_EAST = re.compile(r"CJK|HIRAGANA|KATAKANA|HANGUL|KANGXI|HALFWIDTH|FULLWIDTH")


def plausible(text: str, component: str) -> bool:
    """May train the clean state: letters, marks, blanks, dashes and apostrophes of the scripts
    that the component is for, no run of accented letters throughout, no word of two alphabets but for
    letters that look alike."""
    letters = accented = 0
    for ch in text:
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            letters += 1
            if component == "alphabetic":
                if ch > "\u2fff" and not "\uff00" <= ch < "\uff5f":
                    return False
                accented += "\x7f" < ch < "\u0250"
            elif not _EAST.match(unicodedata.name(ch, "")) or "\uff00" <= ch < "\uff5f":
                return False
        elif not (ch in _SIGNS or kind in ("Mn", "Zs", "Pd", "Cf") or ch in "’ʼ・゙゚"):
            return False
    if 2 * accented > letters >= 4 or _MIXED.search(text):
        return False
    # text that is valid UTF-8 once it is undone has hardly been right
    return text.isascii() or all(restore(text, "utf-8", w) in (None, text) for w in dict(PAIRS)["utf-8"])


@lru_cache(4096)
def block(ch: str) -> str:
    """A coarse class for characters too rare for an emission of their own."""
    o = ord(ch)
    if o < 0x2E80:
        return f"{unicodedata.category(ch)}{o >> 6:x}"
    return f"{unicodedata.category(ch)}{'kana' if 0x3040 <= o < 0x3100 else 'cjk' if 0x4E00 <= o < 0xA000 else 'hangul' if 0xAC00 <= o < 0xD7A4 else format(o >> 8, 'x')}"


@lru_cache(20_000)
def producible(symbol: str) -> np.ndarray:
    """Per state, 1 where the wrong character set has the character behind a symbol, else 0."""
    ch = symbol[-1] if symbol.startswith("look") else symbol
    ok = np.ones(1 + len(states()))
    if len(ch) == 1 and ch > "\x7f":
        for k, (right, wrong) in enumerate(states(), 1):
            if right == "iso2022_jp" or (right == "lost" and wrong == "?"):
                ok[k] = 0
            elif right != "lost" and not (ch == "�" and wrong in _WIDE):
                ok[k] = to_bytes(ch, wrong) is not None
    return ok


def _row(table: tuple, key: object) -> np.ndarray | None:
    at = table[0].get(key)
    return None if at is None else table[1][at].astype(np.float64)


def _sparse_row(table: tuple, key: object, size: int) -> np.ndarray:
    """Counts by state of a key."""
    row = np.zeros(size)
    at = table[0].get(key)
    if at is None:
        return row
    _, starts, states_of, counts = table
    row[states_of[starts[at] : starts[at + 1]]] = counts[starts[at] : starts[at + 1]]
    return row


@dataclass
class Model:
    """Emissions as log probabilities per bigram of symbols, and the weights of the states."""

    symbols: set
    start: np.ndarray
    bigrams: tuple  # place by key, where each place's counts start, their states, the counts
    unigrams: tuple  # each: place by key, and one row of float32 per place
    contexts: tuple
    floor: np.ndarray
    own: float = 0.0  # the share of one use among the clean state's unigrams

    def sequence(self, text: str) -> list[str]:
        """The symbols of a text between its ends, remembered per character."""
        seen = self.__dict__.get("seen")
        if seen is None:
            seen = self.seen = _Symbols(self)
        return ["\x02", *map(seen.__getitem__, text), "\x03"]

    def symbol(self, ch: str) -> str:
        """ASCII letters and digits by kind, look-alike letters as one, other characters themselves
        where they are frequent enough."""
        if ch < "\x80" and ch.isalnum():
            return "a" if ch.islower() else "A" if ch.isupper() else "9"
        if ch in _LOOK_CYRILLIC:
            return "lookо"
        if ch in _LOOK_GREEK:
            return "lookο"
        return ch if ch in self.symbols else block(ch)

    def path_score(self, text: str, labels: np.ndarray) -> float:
        """log probability of a text along the labelled states, without the cost of changes."""
        seq, path = self.sequence(text), [*labels, labels[-1]]
        return float(self.start[path[0]]) + sum(float(self.emission(a, b)[k]) for a, b, k in zip(seq, seq[1:], path))  # noqa: B905

    def clean_score(self, text: str) -> float:
        """log probability of a text in the clean state."""
        seq = self.sequence(text)
        return sum(float(self.emission(a, b)[0]) for a, b in zip(seq, seq[1:]))  # noqa: B905

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("met", "seen")}

    def emission(self, before: str, now: str) -> np.ndarray:
        """`_log_emission`, remembered for the pairs met so far, up to EMISSIONS."""
        met = self.__dict__.setdefault("met", {})
        e = met.get((before, now))
        if e is None:
            if len(met) >= EMISSIONS:
                met.clear()
            e = met[before, now] = self._log_emission(before, now)
        return e

    def _log_emission(self, before: str, now: str) -> np.ndarray:
        """log P(now | before) in every state: bigrams, backed off to unigrams and a floor.

        A state whose wrong character set lacks the character can't emit it.
        """
        return np.log(self._emission(before, now) * producible(now) + 1e-30)

    def _emission(self, before: str, now: str) -> np.ndarray:
        uni, con = _row(self.unigrams, now), _row(self.contexts, before)
        both = _sparse_row(self.bigrams, (before, now), len(self.floor))
        # every text has trained the clean state: its own use does not speak for it
        for counts, own in ((uni, self.own), (both, 1.0), (con, 1.0)):
            if counts is not None:
                counts[0] = max(counts[0] - own, 0.0)
        uni = self.floor if uni is None else uni + self.floor
        if con is None:
            return uni
        n, kinds = np.split(con, 2)
        return (both + (kinds + 0.5) * uni) / (n + kinds + 0.5)


class _Symbols(dict):
    """Symbols of a model by character."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, ch: str) -> str:
        s = self[ch] = self.model.symbol(ch)
        return s


class _Places(dict):
    """Numbers things in the order of their first use."""

    def __missing__(self, x: object) -> int:
        n = self[x] = len(self)
        return n


#: Characters that share one symbol, each by one of them: so counts by character hold no more than needed.
_SHARED = {
    **{i: "a" if chr(i).islower() else "A" if chr(i).isupper() else "9" for i in range(128) if chr(i).isalnum()},
    **dict.fromkeys(map(ord, _LOOK_CYRILLIC), "о"), **dict.fromkeys(map(ord, _LOOK_GREEK), "ο"),
}


def texts_by_state(texts: list[str], component: str) -> list[list[str]]:
    """Plausible texts, and what every pair makes of them, by state. What becomes of a text depends on
    the text alone, so that parts of a corpus can be counted apart."""
    # capitals are rarer than they are plain
    texts = [*texts, *(t.upper() for t in texts if zlib.crc32(t.encode("utf-8", "surrogatepass")) % 4 == 0 and not t.isupper())]
    made = [texts]
    strange = [t for t in texts if not t.isascii()]  # ASCII is the same in all character sets
    for r, w in states():
        group = [d for t in strange if (d := damage(t, r, w)) is not None and d != t]
        if r != "iso2022_jp":  # control characters are often lost on the way
            group += [d for t in group if _CONTROLS.search(t) and not plausible(d := _CONTROLS.sub("", t), component)]
        made.append(group)
    return made


def count_bigrams(texts: list[str], component: str) -> list[Counter]:
    """Uses of character bigrams (two characters; \x02 before the first and \x03 after the last) by state."""
    out = []
    for group in texts_by_state(texts, component):
        whole = "".join(f"\x02{t}\x03" for t in group).translate(_SHARED)
        counts = Counter(map(add, whole, whole[1:]))
        counts.pop("\x03\x02", None)
        out.append(counts)
    return out


def build_model(state: np.ndarray, bigram: list[str], uses: np.ndarray, weights: np.ndarray | None = None) -> Model:
    """The model from uses of character bigrams by state; weights: the share of each state so far."""
    k = 1 + len(states())
    chars = _Places()
    now_char = np.fromiter((chars[b[1]] for b in bigram), np.int64, len(bigram))
    char_uses = np.bincount(now_char, uses, len(chars))
    # a character with fewer uses has no emission of its own, but its block's
    model = Model({c for c, n in zip(chars, char_uses, strict=True) if n >= SYMBOL_USES} | {"\x02", "\x03"}, np.zeros(0), (), (), (), np.zeros(0))
    symbol_of = _Symbols(model)
    symbols, contexts, bigrams = _Places(), _Places(), _Places()
    pairs = [(symbol_of[b[0]], symbol_of[b[1]]) for b in bigram]
    number = lambda places, things: np.fromiter((places[x] for x in things), np.int64, len(pairs))
    place, now, before = number(bigrams, pairs), number(symbols, (b for _, b in pairs)), number(contexts, (a for a, _ in pairs))
    total = np.bincount(state, uses, k)
    uni = np.bincount(now * k + state, uses, len(symbols) * k).reshape(-1, k) / (total + 50.0)
    # several characters may be one symbol: counts of equal (bigram, state) fall together
    cells, at = np.unique(place * k + state, return_inverse=True)
    cell_uses = np.bincount(at, uses, len(cells))
    context_of = np.zeros(len(bigrams), np.int64)
    context_of[place] = before
    slot = context_of[cells // k] * k + cells % k
    con = np.concatenate([np.bincount(slot, x, len(contexts) * k).reshape(-1, k) for x in (cell_uses, cell_uses > 0)], 1)
    # a state that a corpus hardly feeds must not explain what the clean one can't
    texts = np.bincount(state, uses * np.fromiter((b[1] == "\x03" for b in bigram), bool, len(bigram)), k)
    share = np.ones(k - 1) if weights is None else weights + 0.5
    share = np.where(texts[1:] >= 3, share, 0)
    start = np.concatenate(([1 - START_WRONG], START_WRONG * share / max(share.sum(), 1e-9)))
    model.start = np.log(np.maximum(start, 1e-300))
    starts = np.searchsorted(cells // k, np.arange(len(bigrams) + 1))
    model.bigrams = (dict(bigrams), starts.astype(np.int32), (cells % k).astype(np.uint8), cell_uses.astype(np.float32))
    model.unigrams, model.contexts = (dict(symbols), uni.astype(np.float32)), (dict(contexts), con.astype(np.float32))
    model.floor, model.own = np.full(k, 1e-7), 1 / (total[0] + 50.0)
    return model


def _flat(counts: list[Counter], sign: int = 1) -> tuple[list[int], list[str], list[int]]:
    """Counters by state as columns (state, bigram, uses)."""
    return [s for s, c in enumerate(counts) for _ in c], [b for c in counts for b in c], [sign * n for c in counts for n in c.values()]


def label(model: Model, texts: list[str]) -> list[np.ndarray]:
    """Viterbi: the state of every character of each text. Texts of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(texts)
    order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i]))
    stay, leave = math.log1p(-CHANGE), math.log(CHANGE)
    at = 0
    while at < len(order):
        longest = len(texts[order[at]]) + 4
        group = [order[at]]
        at += 1
        while at < len(order) and len(texts[order[at]]) <= longest and len(group) < 512:
            group.append(order[at])
            at += 1
        seqs = [model.sequence(texts[i]) for i in group]
        size = max(map(len, seqs)) - 1
        ids = _Places()
        grid = np.zeros((len(group), size), np.int64)
        for g, seq in enumerate(seqs):
            grid[g, : len(seq) - 1] = [ids[p] for p in zip(seq, seq[1:])]  # noqa: B905
        table = np.array([model.emission(*p) for p in ids])
        ends = np.array([len(s) - 1 for s in seqs])
        score = model.start + table[grid[:, 0]]
        k = score.shape[1]
        back = np.zeros((size, len(group), k), np.int16)
        for j in range(1, size):
            same = score + stay
            into = score[:, :1] + leave + model.start
            best_wrong = 1 + score[:, 1:].argmax(1)
            home = np.take_along_axis(score, best_wrong[:, None], 1)[:, 0] + leave
            step = np.where(into > same, into, same)
            source = np.where(into > same, 0, np.arange(k))
            source[:, 0] = np.where(home > same[:, 0], best_wrong, 0)
            step[:, 0] = np.maximum(home, same[:, 0])
            active = j < ends
            back[j][active] = source[active]
            score = np.where(active[:, None], step + table[grid[:, j]], score)
        here, each = score.argmax(1), np.arange(len(group))
        path = np.zeros((len(group), size), np.int16)
        for j in range(size - 1, -1, -1):
            path[:, j] = here
            if j:
                here = np.where(j < ends, back[j, each, here], here)
        for g, i in enumerate(group):
            out[i] = path[g, : len(texts[i])]
    return out


def main_states(found: list[np.ndarray]) -> list[int]:
    """The state that most of the labelled characters of a text have; 0 where none is labelled."""
    return [int(Counter(f[f > 0].tolist()).most_common(1)[0][0]) if f.any() else 0 for f in found]


def train(texts: list[str], component: str) -> Model:
    """Two rounds: the texts that the first model labels don't train the second."""
    good = [t for t in texts if plausible(t, component)]
    counts = count_bigrams(good, component)
    weights = None
    for _ in range(ROUNDS - 1):
        main = main_states(label(_model_of(counts, weights), texts))
        weights = np.bincount(main, minlength=1 + len(states()))[1:].astype(float)
        wrong = {t for t, m in zip(texts, main, strict=True) if m}
        counts = count_bigrams([t for t in good if t not in wrong], component)
    return _model_of(counts, weights)


def _model_of(counts: list[Counter], weights: np.ndarray | None) -> Model:
    state, bigram, uses = _flat(counts)
    return build_model(np.array(state, np.int64), bigram, np.array(uses, np.float64), weights)


def repair(model: Model, text: str, labels: np.ndarray) -> tuple[str | None, str] | None:
    """(the text with every span restored, or None where a span can't be; the pairs, in order).

    No finding where the inverse transforms change nothing or make a less plausible text.
    """
    pairs, out, used, at = states(), [], [], 0
    while at < len(text):
        to = at
        while to < len(text) and labels[to] == labels[at]:
            to += 1
        span, s = text[at:to], int(labels[at])
        if s:
            whole, span = span, restore(span, *pairs[s - 1])
            if span is None and whole.isascii() and pairs[s - 1] != ("lost", "?"):
                span = whole
            if span != whole:
                used.append(":".join(pairs[s - 1]))
        out.append(span)
        at = to
    if not used:
        return None
    restored = None if None in out else "".join(out)
    # the text may be right after all: as it stands, or with look-alike letters and dashes read as Latin ones
    clean = max(model.clean_score(text) + MARGIN, model.clean_score(text.translate(_READ_AS)))
    if restored is not None and model.clean_score(restored) > clean:
        return restored, ",".join(dict.fromkeys(used))
    # the label's own inverse does not help: the best other one may
    others = [(model.clean_score(r), r, p) for p in pairs if (r := restore(text, *p)) not in (None, text)]
    score, other, pair = max(others, default=(clean, None, None))
    if score > clean:
        return other, ":".join(pair)
    if restored is not None or model.path_score(text, labels) < model.start[0] + model.clean_score(text) + MARGIN:
        return None
    return None, ",".join(dict.fromkeys(used))


_COUNTS = "component string, state int, bigram string, uses bigint"


def _counts_batch(component: str, columns: tuple[list, list, list]) -> pa.RecordBatch:
    state, bigram, uses = columns
    return pa.RecordBatch.from_arrays(
        [pa.array([component] * len(state), pa.string()), pa.array(state, pa.int32()), pa.array(bigram, pa.string()), pa.array(uses, pa.int64())],
        names=["component", "state", "bigram", "uses"],
    )


def _by_component(batch: pa.RecordBatch) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        out.setdefault(c, []).append(t)
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """(component, texts), few enough that what every pair makes of them stays small."""
    for batch in batches:
        for part in range(0, batch.num_rows, 2048):
            yield from _by_component(batch.slice(part, 2048)).items()


def _gathered(counted: Iterator[tuple[str, list[Counter]]], sign: int) -> Iterator[pa.RecordBatch]:
    """Counts of many batches added up, passed on whenever there are GATHERED of them."""
    held: dict[str, list[Counter]] = {}
    for component, counts in counted:
        mine = held.setdefault(component, [Counter() for _ in counts])
        for a, b in zip(mine, counts, strict=True):
            a.update(b)
        if sum(len(c) for m in held.values() for c in m) > GATHERED:
            yield from (_counts_batch(c, _flat(m, sign)) for c, m in held.items())
            held = {}
    yield from (_counts_batch(c, _flat(m, sign)) for c, m in held.items())


def _built(counts: DataFrame) -> dict[str, bytes]:
    """The components' models, pickled, each built in a task of its own; the driver only passes them
    on. Rows without a bigram hold the weights of the states."""

    def build(rows: pa.Table) -> pa.Table:
        component, weighs = rows.column("component")[0].as_py(), pc.is_null(rows.column("bigram"))
        weights, counted = rows.filter(weighs), rows.filter(pc.invert(weighs)).sort_by([("bigram", "ascending"), ("state", "ascending")])
        column = lambda t, n, kind: t.column(n).to_numpy().astype(kind)
        share = np.bincount(column(weights, "state", np.int64), column(weights, "uses", float), 1 + len(states()))[1:] if weights.num_rows else None
        model = build_model(column(counted, "state", np.int64), counted.column("bigram").to_pylist(), column(counted, "uses", float), share)
        return pa.table({"component": pa.array([component], pa.string()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    summed = counts.groupBy("component", "state", "bigram").agg(F.sum("uses").alias("uses")).where("uses <> 0")
    return {r[0]: bytes(r[1]) for r in summed.groupBy("component").applyInArrow(build, "component string, model binary").collect()}


def trained_models(names: DataFrame, components: tuple[str, ...]) -> dict[str, bytes]:
    """`train` on all distinct texts of every component, their counts added up over the tasks; a
    component without texts has no model. The models grow with the distinct bigrams, not the rows."""
    spark = names.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("text")) for c in components)))
    texts = cut_lineage(names.select(each.alias("x")).select("x.component", "x.text").where(F.length("text") > 0).distinct().repartition(parts, "component", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(((c, count_bigrams([t for t in ts if plausible(t, c)], c)) for c, ts in _parts(batches)), 1)

    counts = cut_lineage(texts.mapInArrow(count, _COUNTS).groupBy("component", "state", "bigram").agg(F.sum("uses").alias("uses")))
    models = _built(counts)
    for _ in range(ROUNDS - 1):
        shared = spark.sparkContext.broadcast(models)

        def labelled(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trained = {c: pickle.loads(b) for c, b in shared.value.items()}
            weights: dict[str, Counter] = {}

            def wrong() -> Iterator[tuple[str, list[Counter]]]:
                for c, ts in _parts(batches):
                    main = main_states(label(trained[c], ts)) if c in trained else [0] * len(ts)
                    weights.setdefault(c, Counter()).update(m for m in main if m)
                    yield c, count_bigrams([t for t, m in zip(ts, main, strict=True) if m and plausible(t, c)], c)

            yield from _gathered(wrong(), -1)
            for c, w in weights.items():
                yield _counts_batch(c, (list(w), [None] * len(w), list(w.values())))

        models = _built(counts.union(texts.mapInArrow(labelled, _COUNTS)))
    return models


def wrongly_decoded(
    names: DataFrame, *, key: str = "name_id", components: tuple[str, ...] = ("alphabetic", "ideographic", "phonetic")
) -> DataFrame:
    """(key, component, text, restored, pair): the components that don't hold their original text.

    restored is null where the original does not survive; pair names the character sets (right:wrong)
    or what was lost. Null and empty texts are never found; repeated rows are found each; null keys
    pass through. Whole texts of any length are labelled. One narrow pass with the broadcast models,
    which all distinct texts have trained.
    """
    shared = names.sparkSession.sparkContext.broadcast(trained_models(names, components))
    kind = names.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = {c: pickle.loads(b) for c, b in shared.value.items()}
        for batch in batches:
            at, rows = [], []
            for c, component in enumerate(components, 1):
                model = trained.get(component)
                texts = batch.column(c).to_pylist()
                distinct = list({t for t in texts if t}) if model else []
                found = {}
                for part in range(0, len(distinct), 4096):
                    some = distinct[part : part + 4096]
                    found.update((t, x) for t, f in zip(some, label(model, some), strict=True) if f.any() and (x := repair(model, t, f)))
                for i, t in enumerate(texts):
                    if t in found:
                        at.append(i)
                        rows.append((component, t, *found[t]))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, pa.string()) for x in cols)], names=[key, "component", "text", "restored", "pair"]
            )

    return names.select(key, *components).mapInArrow(run, f"`{key}` {kind}, component string, text string, restored string, pair string")
