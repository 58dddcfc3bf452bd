"""Problem 6: evaluation records that also stand in training, found by a compressed full-text index.

Evaluation codes are indexed in shards of bounded size (``fmindex``): the words of each different code, followed by two words that
are the key of its form. Training codes are searched backwards in these indexes:

1. A code of ``n`` runs (of three words) shares at least ``ceil(t n)`` of them with any partner, so one of its ``n - ceil(t n) + 1``
   rarest must occur there. Each training code is sent to the shards that hold one of these, or its form; most hold none and go
   nowhere. A task opens one shard at a time, that of the codes sent to it.
2. In the shard its runs are counted by backward search; the occurrences of the rarest are located and extended to maximal
   matches, which are merged into spans per pair. The two words of its form are searched likewise.
3. The exact likeness of each pair so found decides.

Equal codes (same runs and same form) are one class throughout; rows are expanded only where pairs of rows are asked for. No step
has a cap, so no pair is lost.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftstone.functions.readings import code_form, weakness_label
from siftstone.llm import fmindex
from siftstone.llm.rarity import bits_for, rarity_sketch, slots
from siftstone.llm.shingles import WordHashes, flat_list, likeness_terms, mix, runs, set_keys, sets, shared, word_hashes
from siftstone.plans.dims import sized
from siftstone.plans.scratch import materialise, scratch_path
from siftstone.sources.tables import table

#: Words a shard of the index holds, twice as many at most unless a single text is longer: some 50 MB a million while it is built.
SHARD_WORDS = 500_000
WIDTH = 3
THRESHOLD = 0.7
#: Training codes of one shard that are searched in one task.
TASK_TEXTS = 10_000
#: Texts and words searched at a time, and located occurrences kept at a time.
_TEXTS, _WORDS, _EXPAND = 2000, 1_000_000, 2_000_000
#: Different codes a task remembers, so as not to send them twice, before it starts anew.
_SEEN = 500_000
_PAD = np.uint64(0x9E3779B97F4A7C15)
#: Words at the end of an indexed text that are not its own: the key of its form.
_FORM = 2


def _form_digests(texts: list) -> list[bytes | None]:
    forms = map(code_form, texts)
    return [f and hashlib.md5(f.encode("utf-8", "surrogatepass")).digest() for f in forms]


def _class_keys(h: np.ndarray, offsets: np.ndarray, forms: list[bytes | None]) -> list[bytes | None]:
    """128-bit key of each code's runs and form; None for a code without words."""
    one, two = set_keys(h, offsets), set_keys(mix(h, 97), offsets)
    return [hashlib.md5(a.tobytes() + b.tobytes() + (f or b"")).digest() if a else None for a, b, f in zip(one, two, forms)]


def _padded(words: np.ndarray, counts: np.ndarray, forms: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text, ``_PAD`` up to ``WIDTH``, then its form's key (or ``_PAD``); texts without words stay empty."""
    full = counts > 0
    own_words = np.where(full, np.maximum(counts, WIDTH), 0)
    offsets = np.concatenate([[0], np.cumsum(own_words + np.where(full, _FORM, 0))])
    flat = np.full(int(offsets[-1]), _PAD, np.uint64)
    own = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    flat[offsets[own] + np.arange(len(words)) - first[own]] = words
    keyed = np.flatnonzero(full & np.array([f is not None for f in forms], bool))
    if len(keyed):
        keys = np.frombuffer(b"".join(forms[k] for k in keyed), np.uint64).reshape(-1, _FORM)
        flat[(offsets[keyed + 1] - _FORM)[:, None] + np.arange(_FORM)] = keys
    return flat, offsets


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))


def _own_runs(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place in ``flat`` of every run of texts as ``_padded`` gives them."""
    counts = np.diff(offsets)
    number = np.maximum(0, counts - _FORM - WIDTH + 1)
    text = np.repeat(np.arange(len(counts)), number)
    at = offsets[:-1][text] + np.arange(len(text)) - (np.cumsum(number) - number)[text]
    h = np.zeros(len(at), np.uint64)
    for k in range(WIDTH):
        h = mix(h * np.uint64(3) + flat[at + k], k + 1)
    return h, text, at


def _take(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = offsets[rows + 1] - offsets[rows]
    out = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(offsets[rows] - out[:-1], n) + np.arange(int(out[-1]))
    return values[at], out


def _prefix(h: np.ndarray, offsets: np.ndarray, order: np.ndarray, top: int, bottom: int) -> np.ndarray:
    """Which entries of the sets ``h``, taken in ``order`` (which keeps sets together), are among the first n - ceil(t n) + 1."""
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - offsets[:-1][text]
    return order[place < (n + (-top * n // bottom) + 1)[text]]


def _evaluation_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store = WordHashes()
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            part = whole.slice(start, 2000)
            texts = part.column(1).to_pylist()
            words, counts = word_hashes(texts, store)
            forms = _form_digests(texts)
            h, offsets = sets(*runs(words, counts, WIDTH), len(texts))
            n = np.diff(offsets)
            least = np.zeros(len(texts), np.uint64)
            if len(h):
                least[n > 0] = np.minimum.reduceat(mix(h, 31), offsets[:-1][n > 0])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(_class_keys(h, offsets, forms), pa.binary()),
                    pa.array(n.astype(np.int32)),
                    pa.array(least.view(np.int64)),
                    _lists(*_padded(words, counts, forms)),
                ],
                ["id", "class", "n", "least", "words"],
            )


def _sharded(classes: DataFrame, shard_words: int) -> DataFrame:
    """``classes`` with ``shard``: neighbouring sizes together and, within them, likely partners (the same least run).

    Shards are cut by the histogram of sizes on a logarithmic scale (some hundred ranges, whatever the data). A range beyond one shard
    is spread by least run; where many codes share one, by key as well. The tables joined hold one row a size range or shard.
    """
    spark = classes.sparkSession
    plan, shard, used = [], 0, 0
    for r in classes.groupBy("size_range").agg(F.sum(F.size("words") + 1).alias("w")).orderBy("size_range").collect():
        parts = -(-r["w"] // shard_words)
        if used and (parts > 1 or used + r["w"] > shard_words):
            shard, used = shard + 1, 0
        plan.append((r["size_range"], shard, parts))
        used += r["w"]
        if parts > 1:
            shard, used = shard + parts, 0
    where = spark.createDataFrame(plan, "size_range int, base int, parts int")
    placed = classes.join(F.broadcast(where), "size_range").withColumn("home", (F.col("base") + F.pmod(F.xxhash64("least"), "parts")).cast("int"))
    held = placed.groupBy("home").agg(F.sum(F.size("words") + 1).alias("w"))
    split = materialise(held.select("home", F.ceil(F.col("w") / (2 * shard_words)).cast("int").alias("cuts")), "homes")
    return placed.join(sized(split), "home").withColumn("shard", F.struct("home", F.pmod(F.xxhash64("class"), "cuts").cast("int").alias("cut")))


def build_index(held: DataFrame, sketch: np.ndarray, shard_words: int = SHARD_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(folder, entry, words, bytes): the index of the classes of ``held`` written to scratch, and by what a shard is entered.

    ``entry`` are the runs among its texts' rarest, and the first words of their form keys, each once a shard.
    """
    spark = held.sparkSession
    top, bottom = likeness_terms(threshold)
    root = scratch_path(spark, "index")
    shipped = spark.sparkContext.broadcast(sketch)

    def build(group: pa.Table) -> pa.Table:
        words = group.column("words").combine_chunks()
        if isinstance(words, pa.ChunkedArray):
            words = pa.concat_arrays(words.chunks)
        flat, offsets = flat_list(words)
        h, at = sets(*_own_runs(flat, offsets)[:2], len(offsets) - 1)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.lexsort((h, slots(h, shipped.value), text))
        forms = flat[offsets[1:] - _FORM]
        entry = np.unique(np.concatenate([h[_prefix(h, at, order, top, bottom)], forms[forms != _PAD]]))
        index = fmindex.build(flat, offsets, np.diff(at).astype(np.int32), np.frombuffer(b"".join(group.column("class").to_pylist()), np.uint64).reshape(-1, 2))
        folder = f"{root}/{uuid.uuid4().hex}"  # a repeated attempt writes another folder
        fmindex.save(folder, index)
        figures = [pa.array(np.full(len(entry), x), pa.int64()) for x in (len(flat), fmindex.stored_bytes(index))]
        return pa.table([pa.array([folder] * len(entry), pa.string()), pa.array(entry.view(np.int64)), *figures], ["folder", "entry", "words", "bytes"])

    sharded = _sharded(held, shard_words).select("shard", "class", "words")
    return materialise(sharded.groupBy("shard").applyInArrow(build, "folder string, entry bigint, words bigint, bytes bigint"), "entries")


def _training_rows(training: DataFrame, sketch: np.ndarray, threshold: float) -> DataFrame:
    """(id, class, entries, words): entries and words only where the sketch leaves a partner possible, and once a task."""
    top, bottom = likeness_terms(threshold)
    kind = training.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(training.schema["id"].dataType)
    shipped = training.sparkSession.sparkContext.broadcast(sketch)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, seen, level = WordHashes(), set(), shipped.value
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                part = whole.slice(start, 2000)
                texts = part.column(1).to_pylist()
                words, counts = word_hashes(texts, store)
                forms = _form_digests(texts)
                h, offsets = sets(*runs(words, counts, WIDTH), len(texts))
                keys = _class_keys(h, offsets, forms)
                if len(seen) > _SEEN:
                    seen.clear()
                fresh = np.array([key is not None and not (key in seen or seen.add(key)) for key in keys], bool)
                own = np.repeat(np.arange(len(texts)), np.diff(offsets))
                common = slots(h, level)
                first = _prefix(h, offsets, np.lexsort((h, common, own)), top, bottom)
                first = first[(common[first] > 0) & fresh[own[first]]]
                heads = np.frombuffer(b"".join(f or bytes(16) for f in forms), np.uint64)[::2]
                formed = np.flatnonzero(fresh & np.array([f is not None for f in forms], bool) & (slots(heads, level) > 0))
                values, text = np.concatenate([h[first], heads[formed]]), np.concatenate([own[first], formed])
                order = np.argsort(text, kind="stable")
                number = np.bincount(text, minlength=len(texts))
                flat, at = _padded(words, counts, forms)
                sent = number > 0
                kept, ends = _take(flat, at, np.flatnonzero(sent))
                spread = np.concatenate([[0], np.cumsum(np.where(sent, np.diff(at), 0))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(id_type), pa.array(keys, pa.binary()), _lists(values[order], np.concatenate([[0], np.cumsum(number)])), _lists(kept, spread)],
                    ["id", "class", "entries", "words"],
                )

    return training.mapInArrow(read, f"id {kind}, class binary, entries array<bigint>, words array<bigint>")


def _spans(t: np.ndarray, t_at: np.ndarray, e: np.ndarray, e_at: np.ndarray, pair: np.ndarray, mine: np.ndarray, theirs: np.ndarray, shift: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per pair: the spans its maximal matches cover once merged, and the words of the longest match.

    ``pair``, ``mine``, ``theirs``, ``shift``: diagonals on which an occurrence was located (place in the index's text minus
    place in the training text). On each, the words that agree make up the matches; those of ``WIDTH`` words or more count.
    """
    t_n, e_n = np.diff(t_at)[mine] - _FORM, np.diff(e_at)[theirs] - _FORM
    low, high = np.maximum(0, -shift), np.minimum(t_n, e_n - shift)
    size = np.maximum(0, high - low)
    own = np.repeat(np.arange(len(pair)), size)
    place = low[own] + np.arange(len(own)) - (np.cumsum(size) - size)[own]
    a = t[t_at[mine][own] + place]
    same = (a > 0) & (a == e[e_at[theirs][own] + place + shift[own]])
    before = np.concatenate([[False], same[:-1] & (own[1:] == own[:-1])])[: len(same)]
    after = np.concatenate([same[1:] & (own[1:] == own[:-1]), [False]])[: len(same)]
    begin, end = np.flatnonzero(same & ~before), np.flatnonzero(same & ~after)
    long = end - begin + 1 >= WIDTH
    begin, end = begin[long], end[long]
    of, a, b = pair[own[begin]], place[begin], place[end] + 1
    longest, spans = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    np.maximum.at(longest, of, b - a)
    order = np.lexsort((a, of))
    of, a, b = of[order], a[order], b[order]
    widest = int(b.max(initial=0)) + 1
    reach = np.maximum.accumulate(of * widest + b)  # the furthest end so far within the pair
    new = np.concatenate([[True], of[1:] * widest + a[1:] > reach[:-1]])[: len(of)]
    np.add.at(spans, of[new], 1)
    return spans, longest


def _pairs(index: dict, flat: np.ndarray, offsets: np.ndarray, top: int, bottom: int) -> Iterator[tuple]:
    """(text, indexed text, same form, likeness, shared, spans, longest) of the given texts and one shard, in columns."""
    symbols = fmindex.symbols_of(index, flat)
    h_all, own_all, at_all = _own_runs(flat, offsets)
    h, begin = sets(h_all, own_all, len(offsets) - 1)
    n = np.diff(begin)
    own = np.repeat(np.arange(len(n)), n)
    distinct, example = np.unique(h_all, return_index=True)
    lo, hi = fmindex.search(index, symbols[at_all[example][:, None] + np.arange(WIDTH)])
    of = np.searchsorted(distinct, h)
    count = (hi - lo)[of]
    seeds = _prefix(h, begin, np.lexsort((h, count, own)), top, bottom)
    seeds = seeds[count[seeds] > 0]
    seeds = seeds[np.argsort(own[seeds], kind="stable")]
    # where each seed stands in its text: its first place there
    order = np.lexsort((at_all, h_all, own_all))
    head = np.concatenate([[True], (h_all[order][1:] != h_all[order][:-1]) | (own_all[order][1:] != own_all[order][:-1])])[: len(order)]
    spot = at_all[order][head] - offsets[:-1][own]
    forms = flat[(offsets[1:] - _FORM)[:, None] + np.arange(_FORM)]
    form_lo, form_hi = fmindex.search(index, symbols[(offsets[1:] - _FORM)[:, None] + np.arange(_FORM)])
    form_hi = np.where((forms == _PAD).all(axis=1), form_lo, form_hi)
    load = np.cumsum(np.bincount(own[seeds], count[seeds], len(n)))
    edges = np.flatnonzero(np.diff(load // _EXPAND)) + 1
    for a, b in zip([0, *edges], [*edges, len(n)]):  # whole texts, with a bounded number of occurrences
        x, y = np.searchsorted(own[seeds], [a, b])
        yield from _matches(index, symbols, offsets, h, begin, own, seeds[x:y], spot, lo[of], count, np.arange(a, b), form_lo, form_hi, top, bottom)


def _matches(index, symbols, offsets, h, begin, own, seeds, spot, lo, count, texts, form_lo, form_hi, top, bottom) -> Iterator[tuple]:
    """The pairs of ``texts``, all of whose seeds are ``seeds``."""
    held, n = len(index["sizes"]), np.diff(begin)
    rows, inverse = np.unique(lo[seeds], return_index=True)
    c = count[seeds][inverse]
    first = np.concatenate([[0], np.cumsum(c)])
    text_of, place = fmindex.locate(index, np.repeat(rows - first[:-1], c) + np.arange(int(first[-1])))
    c = count[seeds]
    which = np.repeat(np.arange(len(seeds)), c)
    at = first[np.searchsorted(rows, lo[seeds])][which] + np.arange(len(which)) - (np.cumsum(c) - c)[which]
    mine, theirs = own[seeds][which], text_of[at]
    shift = place[at] - spot[seeds][which]
    na, nb = n[mine], index["sizes"][theirs]
    able = np.minimum(na, nb) * bottom >= np.maximum(na, nb) * top
    key, shift = (mine * held + theirs)[able], shift[able]
    c = (form_hi - form_lo)[texts]
    rows = np.repeat(form_lo[texts] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
    formed = np.repeat(texts, c) * held + fmindex.locate(index, rows)[0]
    found = np.unique(np.concatenate([key, formed]))
    if not len(found):
        return
    mine, theirs = found // held, found % held
    same_form = np.isin(found, formed)
    indexed, their = np.unique(theirs, return_inverse=True)
    e, e_at = fmindex.extract(index, indexed)
    words = np.where(e > 0, index["vocabulary"][np.maximum(e, 1) - 1], _PAD)
    eh, eb = sets(*_own_runs(words, e_at)[:2], len(indexed))
    both = np.zeros(len(found), np.int64)
    for k in range(0, len(found), 5000):
        both[k : k + 5000] = shared(*_take(h, begin, mine[k : k + 5000]), *_take(eh, eb, their[k : k + 5000]))
    total = n[mine] + np.diff(eb)[their]
    alike = both * (top + bottom) >= total * top
    good = alike | same_form
    # matches of the pairs that hold
    number = np.cumsum(alike) - 1
    least = int(shift.min(initial=0))
    width = int(shift.max(initial=0)) - least + 1
    at = np.searchsorted(found, key)
    kept = alike[at]
    diagonal = np.unique(at[kept] * width + shift[kept] - least)
    at, shift = diagonal // width, diagonal % width + least
    spans, longest = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    spans[alike], longest[alike] = _spans(symbols, offsets, e, e_at, number[at], mine[at], their[at], shift, int(alike.sum()))
    keys = index["keys"]
    for k in np.array_split(np.flatnonzero(good), max(1, int(good.sum()) // 20_000)):
        hide = ~alike[k]
        yield (
            mine[k], [x.tobytes() for x in keys[theirs[k]]], pa.array(same_form[k]), pa.array(both[k] / np.maximum(1, total[k] - both[k]), mask=hide),
            *(pa.array(x[k].astype(np.int32), mask=hide) for x in (both, spans, longest)),
        )


def search_shards(routed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, same_form, likeness, shared, spans, longest) of the codes sent to each shard: (folder, class, words), sorted by folder.

    A task holds one shard and a bounded number of texts at a time.
    """
    top, bottom = likeness_terms(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, index = None, {}
        for whole in batches:
            folders = np.array(whole.column(0).to_pylist(), object)
            words = np.diff(flat_list(whole.column(2))[1])
            cut = np.flatnonzero(folders[1:] != folders[:-1]) + 1
            for a, b in zip([0, *cut], [*cut, len(folders)]):
                if a == b:
                    continue
                if folders[a] != folder:
                    folder, index = folders[a], {}
                    index = fmindex.load(folder)
                while a < b:
                    take = max(1, int(np.searchsorted(np.cumsum(words[a : min(b, a + _TEXTS)]), _WORDS)))
                    part = whole.slice(a, min(take, b - a))
                    a += part.num_rows
                    keys = part.column(1)
                    for mine, *columns in _pairs(index, *flat_list(part.column(2)), top, bottom):
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(mine)), pa.array(columns[0], pa.binary()), *columns[1:]], names)

    names = ["a", "b", "same_form", "likeness", "shared", "spans", "longest"]
    return routed.select("folder", "class", "words").mapInArrow(run, "a binary, b binary, same_form boolean, likeness double, shared int, spans int, longest int")


def class_overlaps(df: DataFrame, id_column: str, text_column: str, split_column: str, training: str = "train", evaluation: tuple[str, ...] = ("val", "test"), shard_words: int = SHARD_WORDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training rows (id, class), evaluation rows (id, class), pairs of classes (a, b, same_form, likeness, shared, spans, longest)).

    Rows without words have a null class. Only shards' and size ranges' counts and the sketch reach the driver.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(split_column).alias("split"))
    kind = df.schema[id_column].dataType.simpleString()
    held = materialise(
        rows.where(F.col("split").isin(*evaluation)).select("id", "text").mapInArrow(_evaluation_rows, f"id {kind}, class binary, n int, least bigint, words array<bigint>"),
        "evaluation",
    )
    size_range = F.floor(F.log("n") * 16).cast("int").alias("size_range")
    classes = materialise(held.where("class is not null").dropDuplicates(["class"]).select("class", "n", "least", "words", size_range), "classes")
    runs_held = classes.agg(F.sum("n")).first()[0] or 0
    pairs_schema = "a binary, b binary, same_form boolean, likeness double, shared int, spans int, longest int"
    learnt = rows.where(F.col("split") == training).select("id", "text")
    sketch = rarity_sketch(classes.select("words").mapInArrow(_entries_of, "runs array<bigint>"), bits_for(2 * runs_held))
    trained = materialise(_training_rows(learnt, sketch, threshold), "training")
    if not runs_held:
        return trained, held, spark.createDataFrame([], pairs_schema)
    entries = build_index(classes, sketch, shard_words, threshold)
    sent = trained.select("class", F.explode("entries").alias("entry"))
    routes = materialise(sent.join(entries.select("entry", "folder"), "entry").select("class", "folder").distinct(), "routes")
    loads = routes.groupBy("folder").agg(F.count("*").alias("c")).select("folder", F.ceil(F.col("c") / TASK_TEXTS).cast("int").alias("cuts"))
    loads = materialise(loads, "loads")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), loads.agg(F.sum("cuts")).first()[0] or 1)
    texts = trained.where(F.size("words") > 0).join(routes.select("class").distinct(), "class", "left_semi").select("class", "words").dropDuplicates(["class"])
    routed = texts.join(routes.join(sized(loads), "folder"), "class").withColumn("cut", F.pmod(F.xxhash64("class"), "cuts"))
    placed = routed.repartition(tasks, "folder", "cut").sortWithinPartitions("folder", "cut")
    return trained, held, materialise(search_shards(placed, threshold), "matches")


def _entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that a text can be entered by: its different runs and the first word of its form's key."""
    for batch in batches:
        flat, offsets = flat_list(batch.column(0))
        h, at = sets(*_own_runs(flat, offsets)[:2], len(offsets) - 1)
        forms = flat[offsets[1:] - _FORM]
        yield pa.RecordBatch.from_arrays([_lists(np.concatenate([h, forms]), np.concatenate([at, at[-1] + 1 + np.arange(len(forms))]))], ["runs"])


def overlaps(df: DataFrame, id_column: str, text_column: str, split_column: str, training: str = "train", evaluation: tuple[str, ...] = ("val", "test"), shard_words: int = SHARD_WORDS) -> DataFrame:
    """(train_id, eval_id, same_form, likeness, shared, spans, longest): all overlaps across the splits.

    A pair has the same form or at least the likeness asked for (then the figures of the match are given, else they are null).
    ``spans`` and ``longest`` are of the matches on which a rare run was located. Rows of other splits or none, and null, blank and
    wordless texts, belong to no pair. Repeated rows are rows of their own.
    """
    trained, held, pairs = class_overlaps(df, id_column, text_column, split_column, training, evaluation, shard_words)
    return (
        pairs.join(trained.select(F.col("class").alias("a"), F.col("id").alias("train_id")), "a")
        .join(held.select(F.col("class").alias("b"), F.col("id").alias("eval_id")), "b")
        .select("train_id", "eval_id", "same_form", "likeness", "shared", "spans", "longest")
    )


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of one training row and one evaluation row that overlap."""
    found = overlaps(table(spark, sf_dir, "dataset_ml_ready", "sample_id", "code", "split"), "sample_id", "code", "split")
    return found.select(F.least("train_id", "eval_id").alias("sample_a"), F.greatest("train_id", "eval_id").alias("sample_b"))


def overlap_report(df: DataFrame, text_column: str, split_column: str, by: tuple[str, ...], shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per ``by`` columns of the evaluation rows: rows, those that overlap with training, those with the same form there, and pairs.

    Pairs are counted by class (training rows per class, summed over the matches of each evaluation class), never made.
    """
    marked = df.select(F.struct(*by).alias("id"), F.col(text_column).alias("text"), F.col(split_column).alias("split"))
    trained, held, pairs = class_overlaps(marked, "id", "text", "split", shard_words=shard_words)
    copies = trained.where("class is not null").groupBy(F.col("class").alias("a")).agg(F.count("*").alias("c"))
    partners = pairs.join(copies, "a").groupBy(F.col("b").alias("class")).agg(F.sum("c").alias("partners"), F.max("same_form").alias("exact"))
    rows = held.groupBy("id", "class").agg(F.count("*").alias("r")).join(partners, "class", "left")
    return rows.groupBy(*[F.col(f"id.{c}").alias(c) for c in by]).agg(
        F.sum("r").alias("n_rows"),
        F.sum(F.when(F.col("partners") > 0, F.col("r")).otherwise(0)).alias("n_overlapping"),
        F.sum(F.when(F.col("exact"), F.col("r")).otherwise(0)).alias("n_same_form"),
        F.sum(F.coalesce("partners", F.lit(0)) * F.col("r")).alias("n_pairs"),
    )


def p6_report(spark, sf_dir: str) -> DataFrame:
    """Evaluation rows, and those that overlap with training, per split, source and label."""
    rows = table(spark, sf_dir, "dataset_ml_ready", "code", "split", "source", "cwe_id").withColumn("cwe_label", weakness_label(F.col("cwe_id")))
    return overlap_report(rows, "code", "split", ("split", "source", "cwe_label"))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
