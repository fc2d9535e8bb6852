"""Near-duplicate classes by Order MinHash, candidates verified by banded alignment.

A text's k-mers are its three-word shingles, labelled with how often they occurred before, so every one is distinct. Each
of SKETCHES hash functions picks the ELL k-mers of least hash and keeps them in text order; that short sequence is one
key. Two texts share a key with a probability that falls with their edit distance, since an edit breaks k-mers and a
move breaks their order. At the similarity of 0.8 texts of one length share about 0.4 of their k-mers even if the edits are evenly
spaced, so a key is shared with a chance of about 1/16 and any of the 72 with 0.98 to 0.99 (scattered edits: above 0.99).
With few words one edit may break every k-mer, so texts of at most SHORT words get SHORT_KEYS more keys from single words. Texts that share a key are a bucket, and every pair of a bucket is compared unless its texts are
in one class already. The first round compares each text with the first and last of its bucket. Where a bucket is still more than one component, its texts are dealt into blocks of about
BLOCK, and each pair of blocks is a task of the second round, which tells pairs apart by exact bounds on bit maps of words and word
pairs; what passes is aligned. A candidate counts if the banded edit distance of the two word sequences is at most
(1 - SIMILARITY) of the longer one. Classes are the connected components of verified links.

Equal texts are one node from the start, whatever their number. Links never come to the driver; components are found by
alternating large and small stars over staged tables.

Defined cases: a null text counts as empty, and all empty texts are equal; a text under five words is one k-mer; the class
id is the smallest doc_id of the class (null only if all are null); repeated rows are equal texts; an empty table gives an
empty result; in ``keep_one`` all columns pass through and of rows with equal doc_id and text one stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, bucketed, hashed_words, in_parts, lookup, mix64, partitions, released, small_batches, staged, table

K, ELL, SKETCHES = 3, 2, 72
SHORT, SHORT_KEYS = 64, 16
SIMILARITY = 0.8
CHUNK_ROWS = 256
BLOCK, BITS, MAX_BITS, FEW = 2048, (16, 4), 17, 2
SIDE_BY_SIDE, ALIGNED, SHORT_ENOUGH, WAITING = 8, 256, 512, 1 << 20
ROWS_A_FILE, CELLS = 50_000, 1 << 19

_ODD = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
_SALT = mix64(np.arange(1001, SKETCHES + 1001, dtype=np.uint64))
_PLACE = 20  # low bits of a hash that hold the place in the text; texts with more k-mers are searched without it
_STEP = np.uint64(0x9E3779B97F4A7C15)


def kmers(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Occurrence-labelled k-mer hashes of a text's word hashes."""
    n = max(1, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(hashes))):
        out = mix64(out * _STEP + hashes[i : i + n] + np.uint64(1))
    order = np.sort(out)
    if (order[1:] == order[:-1]).any():
        by = np.argsort(out, kind="stable")
        group = out[by]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        count = np.empty(n, np.uint64)
        count[by] = (np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))).astype(np.uint64)
        out = np.where(count > 0, mix64(out + count * _STEP), out)
    return out


def sketches(each: list[np.ndarray], count: int = SKETCHES) -> np.ndarray:
    """int64[text, sketch] for the k-mers of texts; ELL is 2: the two least k-mers in text order."""
    size = np.fromiter(map(len, each), np.int64, len(each))
    x, start = np.concatenate(each), np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.minimum(np.arange(len(x)) - np.repeat(start, size), (1 << _PLACE) - 1).astype(np.uint64)
    low, top = np.uint64((1 << _PLACE) - 1), np.uint64(2**64 - 1)
    out = np.empty((len(each), count), np.int64)
    single = size == 1
    far = np.flatnonzero(size > 1 << _PLACE)  # texts whose places do not fit

    def least(h: np.ndarray) -> np.ndarray:
        at = start + (np.minimum.reduceat(h, start) & low).astype(np.int64)
        for i in far:
            at[i] = start[i] + np.argmin(h[start[i] : start[i] + size[i]] >> np.uint64(_PLACE))
        return at

    for j in range(count):
        h = (x ^ _SALT[j]) * _ODD[j]
        h &= ~low
        h |= place
        one = least(h)
        h[one] = top
        two = np.where(single, one, least(h))
        key = mix64(x[np.minimum(one, two)] * _STEP + x[np.maximum(one, two)]) + np.uint64(j)
        out[:, j] = mix64(key).view(np.int64)
    return out


def keys_of(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Keys of texts, from their word hashes; short texts have more."""
    keys = list(sketches([kmers(x) for x in hashes]))
    short = [i for i, x in enumerate(hashes) if K < len(x) <= SHORT]
    if short:
        for i, more in zip(short, sketches([kmers(hashes[i], 1) for i in short], SHORT_KEYS)):
            keys[i] = np.concatenate([keys[i], more])
    return keys


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, digests, texts = batch.columns
        for low, some in in_parts(texts):
            each = keys_of(hashed_words(some))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))
            yield pa.record_batch([ids.slice(low, len(some)), digests.slice(low, len(some)), keys], ["doc_id", "digest", "keys"])


def digest_of(text: Column) -> Column:
    """The 128 bits of md5: equal texts are one node."""
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit("").cast("binary"))))


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if at most ``most``, else a larger number.

    The band starts narrow and grows fourfold until the distance fits, so the work follows the distance and not ``most``.
    """
    if len(a) < len(b):
        a, b = b, a
    apart = len(a) - len(b)
    if apart > most:
        return most + 1
    low = 0
    while low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not b:
        return len(a)
    limit = min(most, max(apart, 31))
    while (distance := _distance_within(a, b, limit)) > limit and limit < most:
        limit = min(most, 4 * limit)
    return distance


def _distance_within(a: list, b: list, most: int) -> int:
    """Bit-parallel: vertical differences of the 2 * most + 1 rows around the diagonal are one integer that slides down a row
    with each column; the distance is followed along the diagonal that ends in the last cell. Where words stand in a is kept
    for the one or two segments under the band.
    """
    apart, width = len(a) - len(b), 2 * most + 1
    mask, size = (1 << width) - 1, max(1024, width)
    segments: dict[int, dict] = {}
    at = 1 << (apart + most)
    up, down, distance = mask >> most << most, 0, apart
    for j, x in enumerate(b):
        found, first = 0, j - most
        for k in range(max(0, first) // size, min(len(a) - 1, j + most) // size + 1):
            places = segments.get(k)
            if places is None:
                segments.pop(k - 2, None)
                places = segments[k] = {}
                for i, y in enumerate(a[k * size : (k + 1) * size]):
                    places[y] = places.get(y, 0) | 1 << i
            if bits := places.get(x):
                shift = k * size - first
                found |= bits << shift if shift >= 0 else bits >> -shift
        found &= mask
        diagonal = ((((found & up) + up) ^ up) | found | down) & mask
        if not diagonal & at:
            distance += 1
            if distance > most:
                return distance
        right = (down | ~(diagonal | up)) & mask
        left = diagonal & up
        moved = diagonal >> 1
        up, down = (left | ~(moved | right)) & mask, moved & right
    return distance


def pairs_of(words: list) -> set:
    """Distinct pairs of adjacent words."""
    return set(zip(words, words[1:]))


def greedy_cost(a: list, b: list, most: int, reach: int = 8) -> int:
    """Edits of one alignment of a and b, or more than most: after a difference it goes on at the nearest two equal words."""
    i = j = cost = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for s in range(1, reach + 1):
            if i + s <= n and j + s <= m and a[i + s : i + s + 2] == b[j + s : j + s + 2]:
                i, j = i + s, j + s
            elif i + s < n and a[i + s : i + s + 2] == b[j : j + 2]:
                i += s
            elif j + s < m and a[i : i + 2] == b[j + s : j + s + 2]:
                j += s
            else:
                continue
            cost += s
            break
        else:
            return most + 1
        if cost > most:
            return cost
    return cost + n - i + m - j


def similar(a: list, b: list, pairs: set, threshold: float = SIMILARITY) -> bool:
    """Whether the aligned words of a and b reach the threshold; pairs are those of a.

    Bounds from both sides decide most cases before the alignment: what is left between a common start and end, words that differ
    place by place, a greedy alignment, and word pairs that only a has, of which one edit makes at most two.
    """
    most = int((1 - threshold) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    low, least = 0, min(len(a), len(b))
    while low < least and a[low] == b[low]:
        low += 1
    high = 0
    while high < least - low and a[-1 - high] == b[-1 - high]:
        high += 1
    if max(len(a), len(b)) - low - high <= most or (len(a) == len(b) and sum(map(ne, a, b)) <= most) or greedy_cost(a, b, most) <= most:
        return True
    if len(pairs.difference(zip(b, b[1:]))) > 2 * most:
        return False
    return banded_distance(a, b, most) <= most


def pair_hashes(a: np.ndarray) -> np.ndarray:
    """Hashes of the distinct pairs of adjacent words, ascending."""
    return np.unique(mix64(a[:-1] * _STEP + a[1:])) if len(a) > 1 else a[:0]


def bounded(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, threshold: float = SIMILARITY) -> bool | None:
    """Whether texts as word hashes reach the threshold, as far as bounds from both sides tell; None if it takes an alignment.

    The bounds are those of ``similar``, in whole arrays. pairs are pair_hashes(a).
    """
    n, m = len(a), len(b)
    most, apart, least = most_edits(n, m, threshold), abs(n - m), min(n, m)
    if apart > most:
        return False
    ahead, behind = a[:least] != b[:least], a[n - least :] != b[m - least :]
    if min(np.count_nonzero(ahead), np.count_nonzero(behind)) + apart <= most:
        return True
    low = int(ahead.argmax())
    high = min(int(behind[::-1].argmax()), least - low)
    if max(n, m) - low - high <= most:
        return True
    other = pair_hashes(b)
    at = np.searchsorted(other, pairs)
    at[at == len(other)] = 0
    if len(pairs) and (np.count_nonzero(other[at] != pairs) if len(other) else len(pairs)) > 2 * most:
        return False
    return None


def most_edits(n: int, m: int, threshold: float = SIMILARITY) -> int:
    return int((1 - threshold) * max(n, m) + 1e-9)


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float = SIMILARITY) -> np.ndarray:
    """Whether the banded edit distance of each two texts is within the threshold.

    Most similar pairs show it in a greedy alignment. Of the others, short pairs of like lengths are aligned side by side, and long ones (or a
    few) one by one, in bits of integers.
    """
    out, short = np.zeros(len(pairs), bool), []
    for i, (a, b) in enumerate(pairs):
        most, longer = most_edits(len(a), len(b), threshold), max(len(a), len(b))
        if abs(len(a) - len(b)) > most:
            continue
        x, y = a.tolist(), b.tolist()
        if greedy_cost(x, y, most) <= most:
            out[i] = True
        elif longer <= SHORT_ENOUGH:
            short.append((longer, i, most))
        else:
            out[i] = banded_distance(x, y, most) <= most
    short.sort()
    for low in range(0, len(short), ALIGNED):
        some = short[low : low + ALIGNED]
        found = _distances([pairs[i] for _, i, _ in some], max(m for _, _, m in some)) if len(some) >= SIDE_BY_SIDE else [banded_distance(pairs[i][0].tolist(), pairs[i][1].tolist(), m) for _, i, m in some]
        for (_, i, most), distance in zip(some, found):
            out[i] = distance <= most
    return out


def _distances(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distances of pairs, exact where they are within the band; lengths of a pair are no further apart than that.

    The cells (i, j) of all pairs are filled from one diagonal of equal i + j to the next: within a diagonal no cell depends on another, so a
    step is a few operations on an array with a column for each pair.
    """
    first, second = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    longest = int(max(first.max(), second.max()))
    words, number = np.unique(np.concatenate([x for p in pairs for x in p]), return_inverse=True)
    kind, far = (np.int16, 14_000) if longest + band < 8_000 else (np.int32, 1 << 29)
    name = np.int16 if len(words) < 32_000 else np.int32
    number = (number + 1).astype(name)
    pad = band + 2
    rows = np.zeros((longest + 2 * pad + band, len(pairs)), name)  # 0 and -1 are no words
    back = np.full(rows.shape, -1, name)  # the first of each pair in reverse
    at = 0
    for c, (n, m) in enumerate(zip(first.tolist(), second.tolist())):
        back[len(back) - pad - n : len(back) - pad, c] = number[at : at + n][::-1]
        rows[pad : pad + m, c] = number[at + n : at + n + m]
        at += n + m
    # Cells of the band have j - i = -band + 2 t on every other diagonal (held[0]) and -band + 1 + 2 t on those between (held[1]).
    held = [np.full((band + 1 - x, len(pairs)), far, kind) for x in (0, 1)]
    held[band % 2][band // 2] = 0
    ends: dict[int, list[int]] = {}
    for c, k in enumerate((first + second).tolist()):
        ends.setdefault(k, []).append(c)
    distance = np.zeros(len(pairs), np.int64)
    for k in range(int((first + second).max()) + 1):
        x = (k + band) % 2
        cells, other = held[x], held[1 - x]
        if k:
            first_i, first_j = (k + band - x) // 2, (k - band + x) // 2  # of t = 0
            low = len(back) - pad - first_i
            cells += rows[pad + first_j - 1 :][: len(cells)] != back[low : low + len(cells)]
            if x:
                step = np.minimum(other[:-1], other[1:])
                step += kind(1)
                np.minimum(cells, step, out=cells)
            elif len(other):
                step = other + kind(1)
                np.minimum(cells[:-1], step, out=cells[:-1])
                np.minimum(cells[1:], step, out=cells[1:])
        for c in ends.get(k, ()):
            distance[c] = cells[(second[c] - first[c] + band - x) // 2, c]
    return distance


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: the leader of a chunk (role 0), then its candidates (role 1). Those that no bound decides wait for each other, whoever their leader is."""
    leader, words, pairs, open_, waiting = None, None, None, [], 0

    def settled() -> list[tuple]:
        links = [(a, node) for (a, node, _, _), ok in zip(open_, aligned([x[2:] for x in open_])) if ok]
        open_.clear()
        return links

    def out(links: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["u", "v"])

    for batch in batches:
        links, (ids, roles, nodes) = [], (batch.column(c).to_pylist() for c in ("a", "role", "node"))
        for low, some in in_parts(batch.column("text")):
            for i, hashes in enumerate(hashed_words(some), low):
                a = ids[i]
                if roles[i] == 0:
                    if leader != a:
                        leader, words, pairs = a, hashes.copy(), pair_hashes(hashes)
                elif leader == a:
                    told = bounded(words, hashes, pairs)
                    if told:
                        links.append((a, nodes[i]))
                    elif told is None:
                        open_.append((a, nodes[i], words, hashes.copy()))
                        waiting += len(words) + len(hashes)
            if waiting > WAITING:
                links, waiting = links + settled(), 0
        yield out(links)
    yield out(settled())


def met(sets: DataFrame) -> DataFrame:
    """(key, node, first, last, n) for the texts of every bucket of two or more. sets: one row for each node, with its keys; staged."""
    rows = sets.select("node", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).where("n > 1")
    buckets = staged(buckets, "dedup-keys")  # staged, so both sides of the join are plain exchanges and a hot key can be split
    out = staged(rows.join(buckets, "key"), "dedup-buckets")
    released(buckets)
    return out


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b, shared): texts, the first or last text of a bucket that they fall in, and in how many they do. rows: met(sets)."""
    both = rows.select("node", F.explode(F.array("first", "last")).alias("a"))
    return both.where(F.col("a") != F.col("node")).groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("shared"))


def bit_maps(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Bits for the hashed words of a text (BITS for each word, or more), and for its hashed pairs of adjacent words; at most 2 ** MAX_BITS."""
    out = []
    for x, bits in zip((hashes, mix64(hashes[:-1] * _STEP + hashes[1:]) if len(hashes) else hashes), BITS):
        width = map_width(len(hashes), bits)
        marks = np.zeros(width, bool)
        marks[(x & np.uint64(width - 1)).astype(np.int64)] = True
        out.append(np.packbits(marks, bitorder="little").tobytes())
    return out[0], out[1]


def map_width(words: int, bits: int) -> int:
    """Bits of a map: a power of two, so maps of texts whose lengths are within the similarity are as wide or one twice the other."""
    return 1 << min(MAX_BITS, max(8, (bits * max(words, 1) - 1).bit_length()))


def _map_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, some in in_parts(batch.column("text")):
            words = hashed_words(some)
            singles, pairs = zip(*map(bit_maps, words))
            node, buckets = (batch.column(c).slice(low, len(some)) for c in ("node", "buckets"))
            yield pa.record_batch([node, pa.array(list(map(len, words)), pa.int64()), pa.array(singles, pa.binary()), pa.array(pairs, pa.binary()), buckets], ["node", "words", "singles", "pairs", "buckets"])


def folded(maps: list[bytes], width: int) -> np.ndarray:
    """Maps as rows of so many bits: folding joins bits, so fewer of one map are missing in another."""
    return np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 64), axis=0) for x in maps])


def _pair_batches(few: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) of each task (key, cls, i, j), whose rows come sorted: left texts (role 0) against each other if i is j, against those
    of role 1 (another block) and of role 2 (the next shorter class).

    Pairs of other roots count that pass exact bounds: an edit takes one word or two pairs of adjacent words from a text, so of texts
    within d edits neither has more than d distinct words, or 2 d pairs, that the other lacks. A pair counts in the least bucket of the
    second round that both texts are in. With few, a task gives only the likeliest so many for each two roots, and if it left any out
    a row with itself and no pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def compare() -> pa.RecordBatch:
            held.sort(key=lambda x: x[3])  # by length: those that a text can be similar to stand together
            node, root, role, size = (np.array(x, np.int64) for x in zip(*(x[:4] for x in held)))
            keys, key, us, vs, lacks = [x[6] for x in held], task[0], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            wide = np.array([map_width(n, BITS[0]) for n in size.tolist()])
            for width in np.unique(wide).tolist():
                some = np.flatnonzero((wide == width) | (wide == 2 * width))
                narrow = min(len(held[some[0]][5]) * 8, width)
                maps = [folded([held[x][4] for x in some], width), folded([held[x][5] for x in some], narrow)]
                counts = [np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in maps]
                n, of = size[some], int((wide[some] == width).sum())  # those of this width come first
                last = np.searchsorted(n, np.floor(n[:of] / SIMILARITY + 1), "right")
                low = 0
                while low < of:
                    high = min(of, low + max(1, CELLS // max(1, int(last[low]) - low)))
                    at, other = np.arange(low, high)[:, None], np.arange(low + 1, int(last[high - 1]))
                    x, y = some[at], some[other]
                    alone = (role[x] == 0) & (role[y] == 0) if task[2] == task[3] else False
                    fit = (other > at) & (root[x] != root[y]) & (alone | ((role[x] == 0) != (role[y] == 0))) & (n[other] - n[at] <= ((1 - SIMILARITY) * n[other] + 1e-9).astype(np.int64))
                    one, two = np.nonzero(fit)
                    one, two, low = one + low, other[two], high
                    edits = ((1 - SIMILARITY) * n[two] + 1e-9).astype(np.int64)
                    lacking = np.zeros(len(one), np.int64)
                    for m, c, edit in zip(maps, counts, (1, 2)):
                        lacking, step = np.empty(len(one), np.int64), max(1, CELLS // m.shape[1])
                        for k in range(0, len(one), step):
                            i, j = one[k : k + step], two[k : k + step]
                            lacking[k : k + step] = np.maximum(c[i], c[j]) - np.bitwise_count(m[i] & m[j]).sum(axis=1, dtype=np.int64)
                        keep = lacking <= edit * edits
                        one, two, edits, lacking = one[keep], two[keep], edits[keep], lacking[keep]
                    one, two = some[one], some[two]
                    least = np.fromiter((min(keys[x] & keys[y]) == key for x, y in zip(one.tolist(), two.tolist())), bool, len(one))
                    us.append(one[least])
                    vs.append(two[least])
                    lacks.append(lacking[least])
            x, y, lacking = (np.concatenate(c) for c in (us, vs, lacks))
            trimmed = []
            if few and len(x):
                one, two = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
                by = np.lexsort((lacking, two, one))
                first = np.concatenate([[0], np.flatnonzero(np.diff(one[by]) | np.diff(two[by])) + 1])
                by = by[np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by)))) < few]
                trimmed = [task] if len(by) < len(x) else []
                x, y = x[by], y[by]
            u, v = node[x], node[y]
            columns = [pa.concat_arrays([pa.array(c), pa.nulls(len(trimmed), pa.int64())]) for c in (np.minimum(u, v), np.maximum(u, v))]
            for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32())):
                columns.append(pa.concat_arrays([pa.nulls(len(x), kind), pa.array([t[i] for t in trimmed], kind)]))
            return pa.record_batch(columns, ["a", "b", *TASK])

        for batch in batches:
            for *at, node, root, role, size, singles, pairs, keys in zip(*(c.to_pylist() for c in batch.columns)):
                if at != task:
                    if held:
                        yield compare()
                    task, held = at, []
                held.append((node, root, role, size, singles, pairs, set(keys)))
        if held:
            yield compare()

    return run


#: What names a task of the second round.
TASK = ("key", "cls", "i", "j")


def block_pairs(members: DataFrame, roots: DataFrame, few: int, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((a, b), tasks that left pairs out) of the second round, staged. members: node, words, singles, pairs and buckets, an array of (key, n).

    only has the tasks that are wanted, if not all are; then the bit maps go to those alone.

    A bucket of n texts is one task if n is at most BLOCK. In a larger one, texts within the similarity have lengths of the same or the
    next class, and the texts of a class are dealt into n / BLOCK blocks: a task (i, j) of a class holds its block i with its block j,
    where j is not less, and with block j of the next shorter class.
    """
    cls = F.floor(F.log(F.greatest(F.col("words"), F.lit(1))) / -float(np.log(SIMILARITY))).cast("int")
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("length", cls)

    def tasks(n: Column, make) -> Column:
        made = F.transform(F.sequence(F.lit(0), n - 1), make)
        return F.when(n > 0, made).otherwise(F.array().cast("array<struct<cls:int,i:int,j:int,role:int>>"))

    def dealt(bucket: Column) -> Column:
        blocks = F.ceil(bucket["n"] / BLOCK).cast("int")
        large = blocks > 1
        cls, block = F.when(large, F.col("length")).otherwise(0), F.pmod(F.xxhash64("node"), blocks).cast("int")
        task = lambda step, i, j, role: F.struct((cls + step).alias("cls"), i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
        each = F.concat(tasks(blocks, lambda x: task(0, block, x, 0)), tasks(block, lambda x: task(0, x, block, 1)), tasks(F.when(large, blocks).otherwise(0), lambda x: task(1, x, block, 2)))
        return F.transform(each, lambda t: F.struct(bucket["key"].alias("key"), t.alias("t")))

    carried = {"root": F.col("root"), "words": F.col("words"), "singles": F.col("singles"), "pairs": F.col("pairs"), "keys": F.col("buckets.key")}
    place = ["d.key", "d.t.cls", "d.t.i", "d.t.j", "node", "d.t.role"]
    each = F.explode(F.flatten(F.transform("buckets", dealt))).alias("d")
    if only is None:
        rows = rooted.select(each, "node", *[c.alias(n) for n, c in carried.items()]).select(*place, *carried)
    else:
        slim = rooted.select(each, "node").select(*place).join(only, list(TASK), "left_semi")
        rows = slim.join(rooted.select("node", *[c.alias(n) for n, c in carried.items()]), "node")
    rows = rows.select(*TASK, "node", "root", "role", "words", "singles", "pairs", "keys")
    lined = rows.repartition(partitions(members.sparkSession), *TASK).sortWithinPartitions(*TASK)
    told = staged(lined.mapInArrow(_pair_batches(few), "a long, b long, key long, cls int, i int, j int").distinct(), "dedup-more")
    return told.where("a IS NOT NULL").select("a", "b"), told.where("a IS NULL").select(*TASK)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar, as links (u, v), staged. pairs is staged. texts: node, text, in buckets by node.

    The rows of a leader meet in one task, but those of leaders with more than 1 / (HOT * partitions) of all pairs are dealt into 2 ** k chunks of about that
    many. The driver holds the names of these leaders, at most HOT * partitions.
    """
    spark = pairs.sparkSession
    counts = staged(pairs.groupBy("a").count(), "dedup-leaders")
    share = max(CHUNK_ROWS, pairs.count() // (HOT * partitions(spark)))
    dealt: dict[int, list[int]] = {}
    for row in counts.where(F.col("count") > share).collect():
        dealt.setdefault((-(-row["count"] // share) - 1).bit_length(), []).append(row["a"])
    chunks = F.lit(1)
    for k, leaders in dealt.items():
        chunks = F.when(F.col("a").isin(leaders), 1 << k).otherwise(chunks)
    row = lambda role, node, chunk: ["a", chunk.cast("int").alias("chunk"), F.lit(role).alias("role"), F.col(node).alias("node")]
    leaders = counts.select("a", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    wanted = pairs.select(*row(1, "b", F.pmod(F.xxhash64("b"), chunks))).unionByName(leaders.select(*row(0, "a", F.col("chunk"))))
    lined = wanted.join(texts, "node").repartition(partitions(spark), "a", "chunk").sortWithinPartitions("a", "chunk", "role")
    links = staged(lined.select("a", "role", "node", "text").mapInArrow(_verify_batches, "u long, v long"), "dedup-similar")
    released(counts)
    return links


def linked(roots: DataFrame | None, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """components() of the classes so far and the similar ones of pairs (staged)."""
    links = verified(pairs, texts)
    known = links if roots is None else roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links)
    out = components(known)
    released(links, *([] if roots is None else [roots]))
    return out


def apart(pairs: DataFrame, best: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """The pairs that are none of best (a row for each b) and whose texts are in two classes, staged. Many pairs may have one leader a: its rows can be split, as roots are staged."""
    of = lambda node, root: roots.select(F.col("node").alias(node), F.col("root").alias(root))
    known = staged(best.select("b", F.col("a").alias("tried")).join(of("b", "rb"), "b", "left"), "dedup-tried")
    rows = pairs.join(known, "b").where("a != tried").join(of("a", "ra"), "a", "left")
    out = staged(rows.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), name)
    released(known)
    return out


def compared(rows: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """components() of all similar pairs that share a bucket; pairs are those of the first round, with how many buckets they share.

    Of the first round, each text is first held against the leader with which it shares most, which puts most texts where they belong, and then
    against its other leaders in other components. The second round looks at the buckets whose texts are not one component yet, first at the
    FEW likeliest pairs of two components in a task, and then, in tasks that had more, at all that are left.
    """
    best = staged(pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b"), "dedup-best")
    roots = linked(None, best, texts)
    rest = apart(pairs, best, roots, "dedup-rest")
    released(best)
    if not rest.isEmpty():
        roots = linked(roots, rest, texts)
    released(rest)
    inner = rows.where("n > 2").select("key", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = inner.groupBy("key").agg(F.min("root").alias("m"), F.max("root").alias("x"), F.count("*").alias("count")).where("m < x")
    mixed = staged(mixed.select("key", "count"), "dedup-mixed")
    if mixed.isEmpty():
        return roots
    inner = lookup(inner.drop("root"), mixed.select("key"), "key", mixed)
    inner = inner.groupBy("node").agg(F.collect_list(F.struct("key", "n")).alias("buckets"))  # at most as many as a text has keys
    inner = staged(inner, "dedup-inner")
    maps = inner.join(texts, "node").select("node", "text", "buckets")
    maps = maps.mapInArrow(_map_batches, f"node long, words long, singles binary, pairs binary, {inner.select('buckets').schema.simpleString()[7:-1].replace(':', ' ', 1)}")
    members = staged(maps, "dedup-members")
    released(inner, mixed)
    more, left_out = block_pairs(members, roots, FEW)
    if not more.isEmpty():
        roots = linked(roots, more, texts)
        if not left_out.isEmpty():
            again, _ = block_pairs(members, roots, 0, left_out)
            again = staged(again.join(more, ["a", "b"], "left_anti"), "dedup-again")
            if not again.isEmpty():
                roots = linked(roots, again, texts)
            released(again)
    released(members)
    return roots


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link (u, v), staged; root is the smallest node of the component.

    A class with a third of all texts is a star at its root: how many edges each node has is known from the aggregation that finds
    the least neighbour, so nodes with many get it by broadcast (lookup) and no task holds all edges of one. Once every node has one edge only or is
    less than all its neighbours, each component is a star around its least node, which that aggregation has told already.
    """
    edges = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = staged(in_files(edges, links.count()), "dedup-links")
    while True:
        n = edges.count()
        # Large star: every node gives its larger neighbours the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("count"))
        least = staged(in_files(least, n), "dedup-least")
        if least.where("count > 1 AND m != u").isEmpty():
            released(edges)
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        # Only the rows to larger neighbours go on.
        large = lookup(both.where("v > u"), least.select("u", "m"), "u", least, total=2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(in_files(large, n), "dedup-large")
        released(edges, least)
        # Small star: every node gives its smaller neighbours, and itself, the smallest of them.
        least = staged(in_files(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("count")), n), "dedup-least")
        small = lookup(large, least.select("u", "m"), "u", least, total=2 * n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(in_files(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), n), "dedup-stars")
        released(large, least)


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """df in no more parts than so many narrow rows ask for: a staged table of few rows is not a file for each partition of a shuffle."""
    parts = -(-rows // ROWS_A_FILE)
    return df.coalesce(max(1, parts)) if parts < partitions(df.sparkSession) else df


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_classified, whose tables are all written here, with small batches for the tasks in Python."""
    with small_batches(docs.sparkSession):
        return _classified(docs)


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, classes): sets has doc_id and digest of every row; classes has a row for each digest with its node, smallest doc_id (id),
    class_id, the root of its class and count, the rows with that text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), F.col("text").cast("binary").alias("text"))
    sets = plain.mapInArrow(_sketch_batches, "doc_id long, digest binary, keys array<long>")
    sets = staged(sets.select("*", F.monotonically_increasing_id().alias("row")), "dedup-sketches")  # written, so a row keeps its number
    nodes = staged(sets.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("id"), F.count("*").alias("count")), "dedup-nodes")
    one = staged(sets.select("row", "keys").join(nodes.select("node"), F.col("row") == F.col("node")).select("node", "keys"), "dedup-one")
    ids = staged(sets.select("doc_id", "digest"), "dedup-ids")
    released(sets)
    rows = met(one)
    released(one)
    pairs = staged(candidates(rows), "dedup-pairs")
    # Texts of the nodes that have candidates.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", F.col("digest").alias("w"), "id")
    texts = plain.join(wanted, (F.col("digest") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
    texts = bucketed(texts, "node", "dedup-texts")
    roots = compared(rows, pairs, texts)
    released(rows, pairs, texts)
    rooted = staged(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "dedup-rooted")
    named = staged(rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("count")), "dedup-named")
    classes = lookup(rooted, named.select("root", "class_id"), "root", named)
    classes = staged(classes.select("digest", "node", "id", "class_id", "root", "count"), "dedup-classes")
    released(nodes, roots, rooted, named)
    return ids, classes


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates: of each class the one with the smallest doc_id, with all its columns."""
    sets, classes = classified(docs)
    # A class whose ids are all null keeps its root.
    stays = F.when(F.col("class_id").isNull(), F.col("node") == F.col("root")).otherwise(F.col("id").eqNullSafe(F.col("class_id")))
    kept = classes.where(stays).select(F.col("digest").alias("w"), "id")
    row = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("d"), digest_of(F.col("text")).alias("digest"))
    rows = rows.join(kept, (F.col("digest") == F.col("w")) & F.col("d").eqNullSafe(F.col("id")), "left_semi")
    again = sets.groupBy("doc_id", "digest").count().where("count > 1").select(F.col("doc_id").alias("i"), F.col("digest").alias("w"))
    if again.isEmpty():
        return rows.select("row.*")
    same = (F.col("digest") == F.col("w")) & F.col("d").eqNullSafe(F.col("i"))
    single = rows.join(again, same, "left_anti").select("row")
    repeated = rows.join(again, same, "left_semi").groupBy("digest", "d").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and whether the document stays, for every document."""
    sets, classes = classified(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lookup(sets, classes.select("digest", "class_id"), "digest", classes).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
