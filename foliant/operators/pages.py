"""Geometry of pages as Arrow batches: the spans of a document come together, and each
task goes through its documents in batches of whole ones.

The rules are those of ``columns`` (body sizes, baselines, scripts, gutters, cut lines);
what is tested on a line's text stays a column expression.  A task holds one batch, or
one document if that is longer.  Numbers of documents, pages, lines and pieces run over
all of a batch.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a block of lines by places where ink begins or ends.
CELLS = 2_000_000
#: Scripts are numbered as they sort: none, sub, sup; with a space before them or not.
BEFORE, BEHIND = pa.array(["", " ", "_{", " _{", "^{", " ^{"]), pa.array(["", "}", "}"])
KINDS = pa.array(["F", "L", "R"])
#: What Java's Unicode ``\\s`` is.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
FLAGS = ("gap", "ragged", "indent", "plain", "math", "bold", "italic", "small", "large")


def heads(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the row before it in any key."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def first_in(start: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The order by keys, and of it the first row of each value of ``start``."""
    order = np.lexsort((*reversed(keys), start))
    return order[heads(start[order])]


def lines_of(page, by, reach):
    """The first baseline of each span's line; a chain of close baselines may hold several."""
    far = heads(page)
    far[1:] |= by[1:] - by[:-1] > reach
    at = np.flatnonzero(far)
    chain = np.cumsum(far) - 1
    line = by[at][chain]
    for k in np.unique(chain[by - line > reach]):
        y = by[at[k]]
        for i in range(at[k], at[k + 1] if k + 1 < len(at) else len(by)):
            if by[i] - y > reach:
                y = by[i]
            line[i] = y
    return line


def scripts_of(page, line, x0, x1, small):
    """(line, script) of each span: lines of small spans alone join the nearest other one."""
    new = heads(page, line)
    at, own = np.flatnonzero(new), np.cumsum(new) - 1
    p, y = page[at], line[at]
    big = np.logical_or.reduceat(~small, at)
    lo, hi, end = np.minimum.reduceat(x0, at), np.maximum.reduceat(x1, at), np.maximum.reduceat(x0, at)
    s = np.flatnonzero(~big)
    best, least = s.copy(), np.full(len(s), np.inf)
    for step in range(-3, 4):  # lines are more than 1.6 points apart
        n = np.clip(s + step, 0, len(at) - 1)
        d = np.abs(y[n] - y[s])
        fits = big[n] & (p[n] == p[s]) & (y[n] * 2 >= y[s] * 2 - 7) & (y[n] * 2 <= y[s] * 2 + 9) & (lo[s] >= lo[n] - 20) & (end[s] <= hi[n] + 20) & (d < least)
        best[fits], least[fits] = n[fits], d[fits]
    to, script = y.copy(), np.zeros(len(at), np.int8)
    dy = y[s] - y[best]
    to[s], script[s] = y[best], np.where(dy < -0.8, 2, np.where(dy > 0.8, 1, 0))
    return to[own], script[own]


def gutters_of(p, at, width, x0, x1, bin_size, gutter, around):
    """The gutter of each line, NaN for none: spans from ``at`` on, in the order of lines."""
    n = len(at)
    bins = lambda x: np.trunc(x / bin_size).astype(np.int64)
    own = np.repeat(np.arange(n), np.diff(np.append(at, len(x0))))
    lo, hi = bins(width * 0.2), bins(width * 0.8)
    b, z = np.maximum(bins(x0), lo[own]), np.minimum(bins(x1) + 1, hi[own])
    ink = z > b
    left, right = np.minimum.reduceat(x1, at), np.maximum.reduceat(x0, at)
    first = np.flatnonzero(heads(p))
    page = np.cumsum(heads(p)) - 1
    begin, stop = first[page], np.append(first, n)[page + 1]
    edges = np.unique(np.concatenate([b[ink], z[ink], lo, hi]))
    place = lambda v: np.searchsorted(edges, v)
    b, z, owner = place(b[ink]), place(z[ink]), own[ink]
    block = max(4 * around, CELLS // len(edges))
    runs = []
    for i in range(0, n, block):
        k = min(i + block, n)
        f, t = max(i - around, 0), min(k + around, n)
        here = slice(*np.searchsorted(owner, [f, t]))
        count = np.zeros((t - f + 1, len(edges)), np.int32)
        np.add.at(count, (owner[here] - f + 1, b[here]), 1)
        np.add.at(count, (owner[here] - f + 1, z[here]), -1)
        total = count.cumsum(axis=1).cumsum(axis=0)
        rows = np.arange(i, k)
        spans = total[np.minimum(rows + around + 1, stop[i:k]) - f] - total[np.maximum(rows - around, begin[i:k]) - f]
        free = np.zeros((k - i, len(edges) + 1), np.int8)
        free[:, 1:] = (spans <= 1) & (edges >= lo[i:k, None]) & (edges < hi[i:k, None])
        turn = np.diff(free, axis=1)
        row, a = np.nonzero(turn == 1)
        runs.append((row + i, edges[a], edges[np.nonzero(turn == -1)[1]]))
    line, a, z = (np.concatenate(c) for c in zip(*runs, strict=True))
    wide = z - a >= int(gutter / bin_size)
    line, a, z = line[wide], a[wide] * bin_size, z[wide] * bin_size

    def near(line, test):
        """How many of the lines around pass."""
        out = np.zeros(len(line), int)
        for step in range(-around, around + 1):
            j = line + step
            ok = (j >= begin[line]) & (j < stop[line])
            out += ok & test(np.clip(j, 0, n - 1))
        return out

    mid, slim = (a + z) / 2, a - z
    out = np.full(n, np.nan)
    w = first_in(line, slim, a)
    x, at_ = mid[w], line[w]
    some = (near(at_, lambda j: left[j] < x) >= 3) | (near(at_, lambda j: right[j] > x) >= 3)
    out[at_[some]] = x[some]
    both = np.flatnonzero((near(line, lambda j: left[j] <= a + 1) >= 3) & (near(line, lambda j: right[j] >= z - 1) >= 3))
    w = both[first_in(line[both], np.abs(mid - width[line] / 2)[both], slim[both], mid[both])]
    out[line[w]] = mid[w]
    return out


def cut_of(line, at, g, x0, x1):
    """(spans, line, kind) of all pieces' spans, by line and kind, in the order they stand in."""
    gs = g[line]
    crossing = (x0 < gs - 3) & (x1 > gs + 3)
    l, r = (x1 <= gs + 3) & ~crossing, (x0 >= gs - 3) & ~crossing
    room = np.minimum.reduceat(np.where(r, x0, np.inf), at) - np.maximum.reduceat(np.where(l, x1, -np.inf), at)
    whole = np.isnan(g) | np.logical_or.reduceat(crossing, at) | (room < 6)
    ws = whole[line]
    parts = [np.flatnonzero(c) for c in (ws, ~ws & l, ~ws & r)]
    i = np.concatenate(parts)
    kind = np.repeat(np.arange(3), [len(x) for x in parts])
    order = np.lexsort((i, kind, line[i]))
    return i[order], line[i[order]], kind[order]


def flows_of(page, y, kind, x0, x1, body):
    """(order, band, gap, ragged, indent) of pieces in the order of pages, lines and kinds: the
    order by bands and columns, whether there is more room above than in a paragraph, the
    piece before ends short of its column, and this one begins farther in."""
    col = page * 3 + kind
    new = lambda order: np.flatnonzero(heads(col[order]))
    edge = []
    for v, high in ((x0, False), (x1, True)):
        order = np.lexsort((v, col))
        at = new(order)
        size = np.diff(np.append(at, len(v)))
        tenth = size // 10
        edge.append((col[order[at]], v[order[at + (size - 1 - tenth if high else tenth)]]))
    (keys, left), (_, right) = edge
    k = np.searchsorted(keys, col)
    left, right = left[k], right[k]
    turn = (heads(kind == 0) & ~heads(page)).astype(int)
    band = np.cumsum(turn)
    band -= band[np.flatnonzero(heads(page))][np.cumsum(heads(page)) - 1]
    order = np.lexsort((kind, band, page))
    was = np.empty(len(y), int)
    was[order[1:]], was[order[0]] = order[:-1], order[0]
    gap = y - y[was] > 1.75 * body
    ragged = x1[was] < right - 0.12 * np.maximum(right - left, 1.0)
    indent = x0 > np.where(kind == 0, x0[was], left) + 4.5
    return order, band, gap, ragged, indent


def bodies(doc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The size, to a tenth, of most spans over 3 points of each document (see ``columns.span_body``)."""
    tenth = lambda v: float(Decimal(repr(v)).quantize(Decimal("0.1"), ROUND_HALF_UP)) if abs(v) < 1e9 else v
    own, code = np.unique(size, return_inverse=True)
    sizes, to = np.unique(np.array([tenth(v) for v in own.tolist()]), return_inverse=True)
    k, n = np.unique(doc * len(sizes) + to[code], return_counts=True)
    d, s = k // len(sizes), sizes[k % len(sizes)]
    d, s, n = (v[s > 3] for v in (d, s, n))
    out = np.full(doc[-1] + 1, 10.0)
    order = np.lexsort((s, n, d))  # the last of a document stays
    out[d[order]] = s[order]
    return out


def joined(t: pa.Array, script, x0, x1, begin, wide: str) -> pa.Array:
    """The text of each piece: scripts marked, a space where there is room of more than a
    point and neither side is CJK."""
    room = np.zeros(len(t), bool)
    room[1:] = x0[1:] - x1[:-1] > 1.0
    room[begin] = False
    if not pc.all(pc.string_is_ascii(t)).as_py():
        like = lambda p: pc.match_substring_regex(t, p).to_numpy(zero_copy_only=False) & (script == 0)
        room &= ~like("^" + wide)
        room[1:] &= ~like(wide + r"\z")[:-1]
    parts = pc.binary_join_element_wise(BEFORE.take(pa.array(script * 2 + room)), t, BEHIND.take(pa.array(script)), "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begin, len(t)), pa.int32()), parts), "")


def laid_out(batch: pa.Table, rules: dict) -> pa.RecordBatch | None:
    """A row for each page of whole documents: its cut lines by bands and columns, and of
    documents in which a line ends in a hyphen the words that begin with one of ``kept``."""
    t = batch["t"].combine_chunks()
    if not pc.all(pc.string_is_ascii(t)).as_py():
        for k, v in rules["ligatures"].items():
            t = pc.replace_substring(t, k, v)
    whole, t = t, pc.utf8_trim(t, WHITE)
    rows = np.flatnonzero(pc.fill_null(pc.not_equal(t, ""), False).to_numpy(zero_copy_only=False))
    if not len(rows):
        return None
    column = lambda c: batch[c].combine_chunks()
    codes = lambda c: pc.dictionary_encode(column(c), null_encoding="encode").indices.to_numpy()
    doc, sheet = np.cumsum(heads_of(batch, "doc")), codes("page")
    by, x0 = (batch[c].to_numpy() for c in ("by", "x0"))
    rows = rows[np.lexsort((x0[rows], by[rows], sheet[rows], doc[rows]))]
    num = {c: batch[c].to_numpy()[rows] for c in ("width", "x0", "x1", "by", "size")}
    t, doc, page = t.take(pa.array(rows)), np.cumsum(heads(doc[rows])) - 1, np.cumsum(heads(doc[rows], sheet[rows]))
    span_doc, body = doc, bodies(doc, num["size"])
    line = lines_of(page, num["by"], rules["baseline"])
    line, script = scripts_of(page, line, num["x0"], num["x1"], num["size"] < body[doc] * 0.82)
    keys = [script, num["x1"], num["x0"], line, page]
    order = np.lexsort(keys)
    if not heads(*[k[order] for k in keys]).all():  # spans on top of each other go by their text
        order = np.lexsort([pc.rank(whole.take(pa.array(rows)), tiebreaker="dense").to_numpy(), *keys])
    x0, x1 = num["x0"][order], num["x1"][order]
    page, y = page[order], line[order]
    new = heads(page, y)
    at, own = np.flatnonzero(new), np.cumsum(new) - 1
    g = gutters_of(page[at], at, num["width"][order][at], x0, x1, rules["bin"], rules["gutter"], rules["around"])
    i, owner, kind = cut_of(own, at, g, x0, x1)
    begin = np.flatnonzero(heads(owner, kind))
    # spans in the order of pieces
    x0, x1, of = x0[i], x1[i], i[begin]
    i = order[i]
    script, size, big = script[i].astype(np.int64), num["size"][i], script[i] == 0
    y, page, kind = y[of], page[of], kind[begin]
    doc = doc[order[of]]
    p0, p1 = np.minimum.reduceat(x0, begin), np.maximum.reduceat(x1, begin)
    order, band, gap, ragged, indent = flows_of(page, y, kind, p0, p1, body[doc])
    raw = joined(t.take(pa.array(i)), script, x0, x1, begin, rules["wide"])
    true = lambda c: pc.fill_null(column(c), False).to_numpy(zero_copy_only=False)[rows[i]]
    every = lambda test: np.logical_and.reduceat(~big | test, begin)
    font = pc.dictionary_encode(column("font"), null_encoding="encode")
    is_math = re.compile(rules["math"], re.ASCII)
    maths = np.array([bool(f and is_math.search(f)) for f in font.dictionary.to_pylist()])[font.indices.to_numpy()[rows[i]]]
    n, n_math = np.add.reduceat(big.astype(int), begin), np.add.reduceat((big & maths).astype(int), begin)
    line_body = np.repeat(body[doc], np.diff(np.append(begin, len(i))))
    flags = (gap, ragged, indent, n > 0, n_math >= np.maximum(1, n // 2), every(true("bold")), every(true("italic")), every(size < line_body - 1.0), every(size > line_body + 1.5))
    items = {"by": pa.array(y[order]), "kind": KINDS.take(pa.array(kind[order])), "x0": pa.array(p0[order]), "x1": pa.array(p1[order]), "band": pa.array(band[order]), "raw": raw.take(pa.array(order))}
    items |= {c: pa.array(v[order]) for c, v in zip(FLAGS, flags, strict=True)}
    words: dict = {d: [] for d in np.unique(doc[pc.ends_with(raw, "-").to_numpy(zero_copy_only=False)]).tolist()}
    if words:
        kept = re.compile(rules["kept"], re.ASCII)
        for d in words:
            mine = t.take(pa.array(np.arange(*np.searchsorted(span_doc, [d, d + 1])))).to_pylist()
            words[d] = sorted({w.lower() for w in kept.findall("\n".join(mine))})
    first = np.flatnonzero(heads(page))
    source = pa.array(rows[i[begin[first]]])
    return pa.RecordBatch.from_pydict({
        "doc": column("doc").take(source), "page": column("page").take(source), "body": pa.array(body[doc[first]]),
        "words": pa.array([words.get(d) for d in doc[first].tolist()], pa.list_(pa.string())),
        "items": pa.ListArray.from_arrays(pa.array(np.append(first, len(page)), pa.int32()), pa.StructArray.from_arrays(list(items.values()), list(items))),
    })


def heads_of(batch: pa.Table, key: str) -> np.ndarray:
    """Whether a row's key isn't that of the row before; a null is a key."""
    new = np.ones(batch.num_rows, bool)
    v = batch[key].combine_chunks()
    a, b = v[1:], v[:-1]
    new[1:] = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if v.null_count:
        new[1:] |= a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
    return new


def whole(batches, key, each):
    """``each`` over tables that end where a run of a key ends."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        starts = np.flatnonzero(heads_of(pa.Table.from_batches([*before, b]), key)[len(before) :])
        if not len(starts):
            held.append(b)
            continue
        done = [*held, b.slice(0, starts[-1])]
        if sum(x.num_rows for x in done):
            yield each(pa.Table.from_batches(done))
        held = [b.slice(starts[-1])]
    if held:
        yield each(pa.Table.from_batches(held))
