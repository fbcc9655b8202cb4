"""Finding benchmark items in documents, re-parameterised ones too, by template windows and slot consistency.

Texts become templates: numbers, names and the units after numbers turn into typed placeholders, other words into lower
case. As a capital at the start of a sentence may be a name or not, and a name may have more words than one, there are two
templates, and a plain one of lower-case tokens for copies in which capitals stand elsewhere. A window is a run of
template tokens. Windows of the items are looked up by hash in the documents; where they match, token by token, they are
set against the item they come from. A window of slots only would match every table of numbers, so it isn't looked up: it
counts where it lies in line with a window of the item that has a word, or where its values are the item's own. The values that stand in the slots must be consistent: over
a set of matched windows of an item in a document, one value of the item always meets one value of the document and the
other way round. Each occurrence has a set that starts with its own windows; the set that covers most counts. Items are taken in blocks of bounded size, each of which is broadcast and compared with all documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import eased, kept, lean, mix, raw

#: Template tokens in a window, and the fewest that an item must have to be looked for.
WINDOW, LEAST = 8, 5
#: Tokens of items in a block that is broadcast.
BLOCK_TOKENS = 1_000_000
#: Raw tokens whose codes a task remembers.
REMEMBERED = 500_000

#: Words that are units where they follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t oz lb lbs pound pounds ton tons ml l litre litres liter liters "
    "gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars "
    "euro euros cent cents degree degrees mph kmh hz khz mhz ghz w kw mw v kb mb gb tb"
).split()

_TOKEN = re.compile(rb"[0-9]+(?:[.,:][0-9]+)*|[A-Za-z\x80-\xff]+|[.!?\n]")
NUMBER, NAME, UNIT, FIRST_WORD = 0, 1, 2, 3
#: Which of the templates has no slots.
PLAIN = 2
_OTHER, _STOP = -1, -2
_CAPITAL = 1 << 32
_UNIT = 1 << 33
_NUMBER = 1 << 34
_LOW = (1 << 31) - 1


class Codes(dict):
    """Codes of raw tokens: the id of the lower-case token, marked if it is a number, capitalised or a unit's name."""

    def __init__(self, vocabulary: dict[bytes, int], grow: bool = False) -> None:
        super().__init__()
        self.vocabulary, self.grow, self.units = vocabulary, grow, {u.encode() for u in UNITS}

    def __missing__(self, token: bytes) -> int:
        if token in b".!?\n":
            return self.setdefault(token, _STOP)
        word = token.lower()
        code = self.vocabulary.setdefault(word, FIRST_WORD + len(self.vocabulary)) if self.grow else self.vocabulary.get(word, _OTHER)
        if code == _OTHER:
            code = _LOW
        code |= (_NUMBER if 48 <= token[0] <= 57 else 0) | (_CAPITAL if token[:1].isupper() else 0) | (_UNIT if word in self.units else 0)
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = code
        return code


#: A template: its tokens (an unknown word is -1) and the raw token at which each starts, with the number of raw tokens last.
Template = tuple[np.ndarray, np.ndarray]


def templates(text: bytes, codes: Codes) -> tuple[list[bytes], list[Template]]:
    """The raw tokens of a text and its templates: typed, with a capitalised word a name where it does not open its sentence;
    merged, with every run of capitalised words in a sentence one name, at its opening too; and plain, without slots."""
    tokens = _TOKEN.findall(text)
    code = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
    stop = code == _STOP
    keep = np.flatnonzero(~stop)
    if not keep.size:
        return [], [(np.empty(0, np.int64), np.zeros(1, np.int64))] * 3
    after = np.concatenate(([True], stop[:-1]))[keep]
    code = code[keep]
    plain = code & _LOW
    plain[plain == _LOW] = _OTHER
    number, capital = (code & _NUMBER) > 0, (code & _CAPITAL) > 0
    unit = ((code & _UNIT) > 0) & np.concatenate(([False], number[:-1])) & ~after
    typed = plain.copy()
    typed[number], typed[capital & ~after], typed[unit] = NUMBER, NAME, UNIT
    name = capital & ~unit
    runs = typed.copy()
    runs[name] = NAME
    starts = np.flatnonzero(~(name & np.concatenate(([False], name[:-1])) & ~after))
    each = np.arange(len(code) + 1)
    raw_tokens = [tokens[i] for i in keep.tolist()] if keep.size < len(tokens) else tokens
    return raw_tokens, [(typed, each), (runs[starts], np.append(starts, len(code))), (plain, each)]


def _slots(ids: np.ndarray, at: np.ndarray, raw_tokens: list[bytes], first: int, last: int) -> list[tuple[int, bytes]]:
    """The types and values of the slots of a template from one token to another."""
    return [(int(ids[i]), b" ".join(raw_tokens[at[i] : at[i + 1]]).lower()) for i in range(first, last) if ids[i] < FIRST_WORD]


def _leading(ids: np.ndarray, n: int) -> np.ndarray:
    """Numbers below 2^22 from four tokens, for the first n places."""
    x, out = ids.astype(np.uint64), np.zeros(n, np.uint64)
    for i in range(4):
        out = (out + x[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
    return out >> np.uint64(42)


def _hashes(ids: np.ndarray, w: int) -> np.ndarray:
    n = len(ids) - w + 1
    x = ids.astype(np.uint64)
    out = np.full(n, w, np.uint64)
    for i in range(w):
        out = mix(out + x[i : i + n])
    return out


#: A window of an item in a text: its place there, the item's tokens from and to, and the pairs of values in its slots.
Window = tuple[int, int, int, tuple[tuple[tuple[int, bytes], tuple[int, bytes]], ...]]


def _consistent(windows: Iterable[Window]) -> tuple[list[Window], int, bool]:
    """Of windows those whose slots agree with all taken before, the tokens they cover and whether all slots are alike."""
    there: dict[tuple[int, bytes], tuple[int, bytes]] = {}
    back: dict[tuple[int, bytes], tuple[int, bytes]] = {}
    taken, covered, alike = [], set(), True
    for window in windows:
        pairs = window[3]
        if all(there.get(x, y) == y and back.get(y, x) == x for x, y in pairs):
            for x, y in pairs:
                there[x], back[y] = y, x
                alike &= x == y
            covered.update(range(window[1], window[2]))
            taken.append(window)
    return taken, len(covered), alike


def _near(windows: list[Window], starts: set[Window], best: int) -> tuple[int, bool, int]:
    """As _best, over sets that begin with one of `starts`, take what is in line with it, then others, the nearest first.

    Sets of windows are the bits of numbers, in the order of `windows`: a binding of two values rules out the windows that
    bind either of them otherwise, so that a set is done after as many steps as it has windows.
    """
    of_item, of_text, of_both, in_line = (defaultdict(int) for _ in range(4))
    for k, (p, a, _, pairs) in enumerate(windows):
        in_line[p - a] |= 1 << k
        for x, y in pairs:
            of_item[x] |= 1 << k
            of_text[y] |= 1 << k
            of_both[x, y] |= 1 << k
    against = {(x, y): (of_item[x] | of_text[y]) & ~both for (x, y), both in of_both.items()}
    covers = [(1 << b) - (1 << a) for _, a, b, _ in windows]
    left, found = sum(1 << k for k, x in enumerate(windows) if x in starts), (best, False, 0)
    while left:
        first = (left & -left).bit_length() - 1
        p, a, *_ = windows[first]
        bound, covered, taken, alive = set(), 0, [], (1 << len(windows)) - 1
        for todo in (in_line[p - a], ~in_line[p - a]):
            while todo := todo & alive:
                after, before = todo >> first, todo & ((1 << first) - 1)
                k = first + (after & -after).bit_length() - 1 if after else -1
                if before and (k < 0 or p - windows[before.bit_length() - 1][0] <= windows[k][0] - p):
                    k = before.bit_length() - 1
                for pair in windows[k][3]:
                    if pair not in bound:
                        bound.add(pair)
                        alive &= ~against[pair]
                alive &= ~(1 << k)
                covered |= covers[k]
                taken.append(k)
        left &= left - 1
        found = max(found, (covered.bit_count(), all(x == y for x, y in bound), len({windows[k][:2] for k in taken})))
    return found


def _best(windows: list[Window], length: int) -> tuple[int, bool, int]:
    """Tokens covered, all slots alike, and windows, of the set of consistent windows that covers most; `length` is the item's.

    The windows whose slots are all alike are a set; so are those that agree in the order of the text, with the alike ones
    first or not. Each window left over starts one, to which those of its own alignment are added first, the nearest
    before others; these sets lie within twice the item's length. So every occurrence is judged by its own values, parts
    that lie apart still add up, and the work grows with the length of the text.
    """
    most = len(set().union(*(range(a, b) for _, a, b, _ in windows)))
    exact = [x for x in windows if all(y == z for y, z in x[3])]
    best, left = (0, False, 0), set(windows)
    for order in (windows, exact + [x for x in windows if any(y != z for y, z in x[3])], exact):
        taken, covered, alike = _consistent(order)
        best = max(best, (covered, alike, len({x[:2] for x in taken})))
        left.difference_update(taken)
    parts: dict[int, list[Window]] = defaultdict(list)
    for x in windows if best[0] < most else ():
        for part in (x[0] // (2 * length) - 1, x[0] // (2 * length)):
            parts[part].append(x)
    for own in parts.values():
        if best[0] < len(set().union(*(range(a, b) for _, a, b, _ in own))):
            best = max(best, _near(own, left, best[0]))
    return best


class Index:
    """Windows of the templates of items (id, text). Templates of fewer than WINDOW tokens are one window, of fewer than LEAST none."""

    def __init__(self, items: list[tuple[object, bytes]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        codes = Codes(self.vocabulary, grow=True)
        self.items = [(i, *templates(text, codes)) for i, text in items]
        self.lengths = np.array([len(own) for _, own, _ in self.items], np.int64)
        #: The templates of all items end to end, the raw token at which each token starts, and where an item's begins.
        self.ids, self.starts, self.begin = [], [], []
        for form in range(3):
            forms = [x[form] for _, _, x in self.items]
            self.ids.append(np.concatenate([np.empty(0, np.int64), *(np.append(ids, _OTHER) for ids, _ in forms)]))
            self.starts.append(np.concatenate([np.empty(0, np.int64), *(at for _, at in forms)]))
            self.begin.append(np.concatenate(([0], np.cumsum([len(at) for _, at in forms], dtype=np.int64))))
        #: Places of the windows of an item's template that are slots only, and the raw tokens in these.
        self.bare: dict[tuple[int, int], np.ndarray] = {}
        self.bare_tokens = np.zeros(len(self.items), np.int64)
        places: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for k, (_, _, forms) in enumerate(self.items):
            for form, (ids, starts) in enumerate(forms):
                if len(ids) >= LEAST:
                    h = _hashes(ids, w := min(WINDOW, len(ids)))
                    words = np.concatenate(([0], np.cumsum(ids >= FIRST_WORD)))
                    bare = (words[w:] == words[:-w]) & (form != PLAIN)
                    if bare.any():
                        self.bare[k, form] = np.flatnonzero(bare)
                        self.bare_tokens[k] += len(set().union(*(range(starts[j], starts[j + w]) for j in self.bare[k, form].tolist())))
                    at = np.flatnonzero(~bare)
                    places[form, w].append((h[at], np.full(len(at), k), at, _leading(ids, len(h))[at]))
        self.windows: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.leading: dict[tuple[int, int], np.ndarray] = {}
        for key, parts in sorted(places.items()):
            h, item, at, lead = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.windows[key] = h[order], item[order], at[order]
            leading = np.zeros(1 << 22, bool)
            leading[lead] = True
            self.leading[key] = np.packbits(leading)

    def _window(self, k: int, form: int, i: int, j: int, w: int, raw_tokens: list[bytes], forms: list[Template]) -> Window | None:
        """The window of a template of item k at token j that is at token i of a text; None if its own slots disagree."""
        _, values, own = self.items[k]
        a, b = int(own[form][1][j]), int(own[form][1][j + w])
        if form == PLAIN:  # slots of both other templates
            same = {x for ids, at in own[:PLAIN] for x in _slots(ids, at, values, int(np.searchsorted(at, a)), int(np.searchsorted(at, b, "right")) - 1)}
            pairs = {(x, x) for x in same}
        else:
            pairs = set(zip(_slots(*own[form], values, j, j + w), _slots(*forms[form], raw_tokens, i, i + w)))
        if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
            return int(forms[form][1][i]), a, b, tuple(sorted(pairs))
        return None

    def _along(self, k: int, forms: list[Template], places: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """The windows of slots only of item k that match a text in line with the places found by words."""
        for form, shift in sorted({(form, i - j) for form, i, j, _ in places}):
            if (at := self.bare.get((k, form))) is not None:
                ids, own = forms[form][0], self.items[k][2][form][0]
                w = min(WINDOW, len(own))
                at = at[(at + shift >= 0) & (at + shift + w <= len(ids))]
                for x in range(w):
                    at = at[own[at + x] == ids[at + shift + x]]
                yield from ((form, j + shift, j, w) for j in at.tolist())

    def matches(self, text: bytes, codes: Codes, least: int, share: float) -> list[tuple[object, int, int, float, bool]]:
        """(item id, windows, tokens, covered part, all slots alike) of the items found in a text, in the order of items."""
        raw_tokens, forms = templates(text, codes)
        known = [np.concatenate(([0], np.cumsum(ids >= 0))) for ids, _ in forms]
        #: of each template, hashes of its windows in order with their places, and the windows of items that have these hashes
        here: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        wanted: list[np.ndarray] = []
        for (form, w), (h, item, at) in self.windows.items():
            ids = forms[form][0]
            if len(ids) < w:
                continue
            lead = _leading(ids, len(ids) - w + 1)
            bits = self.leading[form, w][lead >> np.uint64(3)] >> (7 - (lead & np.uint64(7)).astype(np.uint8)) & 1
            open_at = np.flatnonzero((bits > 0) & (known[form][w:] - known[form][:-w] == w))
            if not len(open_at):
                continue
            own = np.full(len(open_at), w, np.uint64)
            for i in range(w):
                own = mix(own + ids[open_at + i].astype(np.uint64))
            order = np.argsort(own, kind="stable")
            here[form, w] = own[order], open_at[order]
            each = np.unique(own)
            first = np.searchsorted(h, each)
            n = np.searchsorted(h, each, "right") - first
            which = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
            a = self.starts[form][self.begin[form][item[which]] + at[which]]
            b = self.starts[form][self.begin[form][item[which]] + at[which] + w]
            wanted.append(np.stack((item[which], np.full(len(which), form), np.full(len(which), w), at[which], a, b, h[which].view(np.int64))))
        if not wanted:
            return []
        windows_of = np.concatenate(wanted, axis=1)
        # tokens of each item in its windows: ends in the order of places, each counted from the last end on
        windows_of = windows_of[:, np.lexsort((windows_of[4], windows_of[0]))]
        base = windows_of[0] * (int(self.lengths.max()) + 1)
        ends = np.maximum.accumulate(base + windows_of[5])
        new = np.maximum(ends - np.maximum(base + windows_of[4], np.concatenate(([0], ends[:-1]))), 0)
        need = np.maximum(np.minimum(least, self.lengths), share * self.lengths)
        enough = np.bincount(windows_of[0], new, len(self.items)) + self.bare_tokens >= need
        windows_of = windows_of[:, enough[windows_of[0]]]
        items, begin = np.unique(windows_of[0], return_index=True)
        out = []
        for k, some in zip(items.tolist(), np.split(windows_of, begin[1:], axis=1)):
            item_id, own, _ = self.items[k]
            places: list[tuple[int, int, int, int]] = []
            for form, w in sorted(set(zip(some[1].tolist(), some[2].tolist()))):
                j, h = some[3:7:3, (some[1] == form)]
                places += self._places(k, form, w, j, h.view(np.uint64), *here[form, w], forms[form][0])
            places += self._along(k, forms, places)
            windows = sorted({x for form, i, j, w in places if (x := self._window(k, form, i, j, w, raw_tokens, forms))})
            if windows and len(set().union(*(range(a, b) for _, a, b, _ in windows))) >= need[k]:
                covered, alike, n = _best(windows, len(own))
                if covered >= need[k]:
                    out.append((item_id, n, covered, covered / len(own), alike))
        return out

    def _places(self, k: int, form: int, w: int, j: np.ndarray, h: np.ndarray, hashes: np.ndarray, at: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(form, place in the text, place in item k, w) of the windows j of the item, of hashes h, that stand in a text.

        A window that binds the same values wherever it stands, as plain ones and those without slots do, counts once
        within the item's length.
        """
        first = np.searchsorted(hashes, h)
        n = np.searchsorted(hashes, h, "right") - first
        p, j = at[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)], np.repeat(j, n)
        whole, fixed = np.ones(len(p), bool), np.ones(len(p), bool)
        for i in range(w):
            token = self.ids[form][self.begin[form][k] + j + i]
            whole &= token == ids[p + i]
            fixed &= (token >= FIRST_WORD) | (form == PLAIN)
        order = np.flatnonzero(whole)[np.lexsort((p[whole], j[whole]))]
        p, j, fixed = p[order], j[order], fixed[order]
        part = p // self.lengths[k]
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (j[1:] != j[:-1])))[: len(p)] | ~fixed
        p, j = p[new], j[new]
        return [(form, x, y, w) for x, y in zip(p.tolist(), j.tolist())]


def _indexes(benchmark: DataFrame, key: str, block_tokens: int) -> Iterator[Index]:
    """Indexes of the items, block by block; a block has about `block_tokens` tokens."""

    @eased
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(_TOKEN.findall(t or b"")) for t in raw(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "n"])

    items = lean(benchmark).select(F.col(key).alias("id"), "text").where("text is not null").distinct()
    items = kept(items.mapInArrow(counted, T.StructType([*items.schema.fields, T.StructField("n", T.LongType())])))
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_tokens))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).select("id", "text").toArrow()
        rows = sorted(zip(own.column("id").to_pylist(), own.column("text").to_pylist()), key=lambda x: (x[0] is None, x[0], x[1]))
        yield Index([(i, t.encode()) for i, t in rows])


def contaminations(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.3, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each benchmark item found in a document: doc_id, item_id, n_windows, n_tokens, coverage, exact.

    An item is found if windows that match with consistent slots cover `least` of its tokens (all, if it has fewer) and
    the part `share` of it. exact: every slot has the item's own value. Null and empty texts on either side match
    nothing; items of fewer than five tokens are too short to tell; equal rows of docs each give their rows; an empty
    table gives none. Only doc_id and text, item_id and text are read; documents are not shuffled.
    """
    docs = docs.select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), *T.StructType.fromDDL("n_windows long, n_tokens long, coverage double, exact boolean").fields])
    out = None
    for index in _indexes(benchmark, "item_id", block_tokens):
        given = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            codes, to = Codes(given.value.vocabulary), to_arrow_schema(schema)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))) if t for m in given.value.matches(t, codes, least, share)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(to), to)], schema=to)

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.3, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs without the documents in which an item is found; all columns stay. Nothing is shuffled."""
    for index in _indexes(benchmark, "item_id", block_tokens):
        given = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            codes = Codes(given.value.vocabulary)
            for batch in batches:
                yield batch.filter(pa.array([not (t and given.value.matches(t, codes, least, share)) for t in raw(batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
