"""Problem 9: the natural language of texts and of their blocks, by prediction by partial matching.

One context tree per language holds how often each byte followed each context of up to four bytes of the same word. The code
length of a word under a tree is exact PPM (escape method C, with exclusion) with the statistics frozen: a word costs the same
wherever it stands, so each worker computes a word once. A sentence has the language whose tree codes it in the fewest bits; a block
that of most of its letters, a text that of most letters outside code.

The trees are fitted on a bounded sample of labelled texts (``SAMPLE_ROWS``). As labels can be wrong and texts mixed, the
sample's sentences are assigned anew by the first trees, and the trees fitted again.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.sources.tables import table

#: Languages and the names they go by. Fixed values.
NAMES = {
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "it": ("it", "ita", "italian", "italiano"),
    "ru": ("ru", "rus", "russian", "русский"),
}
LANGUAGES = tuple(NAMES)
_NAMED = {n: lang for lang, names in NAMES.items() for n in names}
#: Labelled texts the trees are fitted on at most, the first in hashed order.
SAMPLE_ROWS = 3000
ORDER = 4
ROUNDS = 2
#: Words whose costs a worker keeps before it starts anew.
STORE = 300_000

_LINE = re.compile(r"\r?\n")
_SENTENCE = re.compile(r"(?<=[.!?…»”])\s+|\n")
_TOKEN = re.compile(r"`[^`\n]*`|\w+")


def named_language(label: str | None) -> str | None:
    """The language a label names: a code with or without region, or a name; None for any other label."""
    name = unicodedata.normalize("NFC", label or "").strip().lower()
    return _NAMED.get(name) or _NAMED.get(re.split(r"[-_ ]", name)[0] if re.fullmatch(r"[a-z]{2,3}[-_ ][a-z0-9]{2,4}", name) else "")


def blocks_of(text: str) -> list[str]:
    """The runs of lines that aren't blank, in order."""
    out, lines = [], []
    for line in [*_LINE.split(text), ""]:
        if line and not line.isspace():
            lines.append(line)
        elif lines:
            out.append("\n".join(lines))
            lines = []
    return out


def natural(token: str) -> str | None:
    """The word to be coded, in lower case, or None for an identifier, a number or quoted code."""
    if not token.isalpha():
        return None
    if not (token.islower() or token.isupper() or token[1:].islower() or not token.lower() != token.upper()):
        return None
    return token.lower()


class Trees:
    """The context trees of all languages, frozen."""

    def __init__(self, words: dict[str, Counter]):
        self.nodes = {lang: self._fit(words.get(lang, Counter())) for lang in LANGUAGES}
        self.known: dict[bytes, np.ndarray] = {}

    @staticmethod
    def _fit(words: Counter) -> dict[bytes, dict[int, int]]:
        nodes: dict[bytes, dict[int, int]] = {}
        for word, n in words.items():
            plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
            for form, times in ((word, n), *([(plain, -(-n // 4))] if plain != word else [])):
                data = b" " + form.encode("utf-8", "surrogatepass") + b" "
                for i in range(1, len(data)):
                    for k in range(min(i, ORDER) + 1):
                        node = nodes.setdefault(data[i - k : i], {})
                        node[data[i]] = node.get(data[i], 0) + times
        return nodes

    @staticmethod
    def _bits(nodes: dict[bytes, dict[int, int]], context: bytes, symbol: int) -> float:
        bits, barred = 0.0, set()
        for k in range(len(context), -1, -1):
            node = nodes.get(context[len(context) - k :])
            if node is None:
                continue
            seen = {s: c for s, c in node.items() if s not in barred} if barred else node
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return bits + log2(total / seen[symbol])
            bits += log2(total / len(seen))
            barred.update(seen)
        return bits + log2(max(1, 256 - len(barred)))

    def cost(self, word: str) -> np.ndarray:
        """Bits of ``word`` under each language's tree."""
        data = b" " + word.encode("utf-8", "surrogatepass") + b" "
        total = np.zeros(len(LANGUAGES))
        for i in range(1, len(data)):
            key = data[max(0, i - ORDER) : i + 1]
            bits = self.known.get(key)
            if bits is None:
                if len(self.known) >= 4 * STORE:
                    self.known.clear()
                bits = self.known[key] = np.array([self._bits(self.nodes[x], key[:-1], key[-1]) for x in LANGUAGES])
            total += bits
        return total


class Coder:
    """Costs of sentences, with the words' costs kept."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.used = 0
        self.costs, self.letters = np.zeros((1024, len(LANGUAGES))), np.zeros(1024)

    def _add(self, token: str) -> int:
        word = natural(token)
        if word is None:
            self.number[token] = -1
            return -1
        k = self.used
        while k >= len(self.letters):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.costs[k], self.letters[k] = self.trees.cost(word), len(word)
        self.number[token] = k
        self.used = k + 1
        return k

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits by language, letters) of each sentence."""
        if len(self.number) > STORE:
            self.reset()
        get, add = self.number.get, self._add
        found = [_TOKEN.findall(unicodedata.normalize("NFC", t)) for t in texts]
        ids = np.array([k if (k := get(w)) is not None else add(w) for ws in found for w in ws], np.int64)
        own = np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), np.int64, len(found)))
        own, ids = own[ids >= 0], ids[ids >= 0]
        bits = np.stack([np.bincount(own, self.costs[ids, x], len(texts)) for x in range(len(LANGUAGES))], axis=1) if len(texts) else np.zeros((0, len(LANGUAGES)))
        return bits, np.bincount(own, self.letters[ids], len(texts))


def _sentences_of(text: str) -> list[tuple[int, str]]:
    """(block number, sentence) of everything outside code."""
    return [(k, s) for k, b in enumerate(blocks_of(text), 1) if not b.startswith("```") for s in _SENTENCE.split(b) if s]


def fit(sample: list[tuple[str, str]], rounds: int = ROUNDS) -> Trees:
    """Trees from (text, language) rows, their sentences being reassigned ``rounds`` times."""
    sentences = [(lang, s) for text, lang in sample for _, s in _sentences_of(text)]
    given = [lang for lang, _ in sentences]
    texts = [s for _, s in sentences]
    tokens = [[w for t in _TOKEN.findall(unicodedata.normalize("NFC", s)) if (w := natural(t))] for s in texts]
    trees = Trees({})
    for turn in range(rounds + 1):
        words: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES}
        for lang, ws in zip(given, tokens):
            words[lang].update(ws)
        trees = Trees(words)
        if turn < rounds and texts:
            bits, letters = Coder(trees).sentences(texts)
            given = [LANGUAGES[k] if n else lang for k, n, lang in zip(bits.argmin(axis=1), letters, given)]
    trees.known = {}
    return trees


def sample_of(df: DataFrame, id_column: str, text_column: str, label_column: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """The first ``rows`` labelled texts in hashed order, with their languages: all that ever reaches the driver."""
    names = "|".join(sorted(_NAMED, key=len, reverse=True))
    labelled = (
        df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(label_column).alias("label"))
        .where("text is not null and label is not null")
        .where(F.lower(F.col("label")).rlike(rf"^[^\p{{L}}]*({names})([^\p{{L}}]|$)"))
        .withColumn("__h", F.shiftrightunsigned(F.xxhash64(F.lit(9), "id"), 32))
    )
    # one count over the labels says up to which hash about 1.1 times the rows lie: only these texts are gathered
    held = labelled.count()
    limit = min(1 << 32, int(1.1 * rows / max(1, held) * (1 << 32)) + 1)
    picked = sorted(labelled.where(F.col("__h") < limit).limit(2 * rows).collect(), key=lambda r: (r["__h"], str(r["id"])))[:rows]
    return [(r["text"], lang) for r in picked if (lang := named_language(r["label"]))]


def identify(df: DataFrame, trees: Trees, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """(id, block_no, lang, confidence, letters, labelled, mixed) per text (block_no 0) and per block outside code.

    ``confidence`` is the letter-weighted probability of ``lang`` over the sentences, from the code lengths. ``labelled`` is the language the
    label names, null if none; ``mixed`` tells that the text's blocks are not all of one language. Null and
    blank texts, and blocks without a natural word, have no row. Repeated identifiers are texts of their own.
    """
    kind = df.schema[id_column].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(trees)
    names = ["id", "block_no", "lang", "confidence", "letters", "labelled", "mixed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shipped.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                part = whole.slice(start, 500)
                rows = _rows(coder, part.column(1).to_pylist(), part.column(2).to_pylist())
                columns = list(zip(*rows)) or [()] * 7
                types = [pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(c, t) for c, t in zip(columns[1:], types)]], names)

    picked = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(label_column).alias("label")).where("text is not null")
    return picked.mapInArrow(run, f"id {kind}, block_no int, lang string, confidence double, letters bigint, labelled string, mixed boolean")


def _rows(coder: Coder, texts: list[str], labels: list) -> list[tuple]:
    parts = [(k, b, s) for k, t in enumerate(texts) for b, s in _sentences_of(t)]
    if not parts:
        return []
    bits, letters = coder.sentences([s for _, _, s in parts])
    text, block = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    full = letters > 0
    bits, letters, text, block = bits[full], letters[full], text[full], block[full]
    if not len(text):
        return []
    chance = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000))
    chance /= chance.sum(axis=1, keepdims=True)
    votes = np.zeros_like(bits)
    votes[np.arange(len(bits)), bits.argmin(axis=1)] = letters

    def gather(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.add.reduceat(letters, at)
        best = np.add.reduceat(votes, at).argmax(axis=1)
        sure = np.add.reduceat(chance * letters[:, None], at)[np.arange(len(at)), best] / n
        return best, sure, n

    by_block = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (block[1:] != block[:-1])]))
    best, sure, n = gather(by_block)
    whole = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    best_t, sure_t, n_t = gather(whole)
    block_text = text[by_block]
    low, high = np.full(len(texts), len(LANGUAGES)), np.full(len(texts), -1)
    np.minimum.at(low, block_text, best)
    np.maximum.at(high, block_text, best)
    mixed = (low != high).tolist()
    named = [named_language(x) for x in labels]
    rows = [(t, 0, LANGUAGES[b], float(s), int(c), named[t], mixed[t]) for t, b, s, c in zip(text[whole].tolist(), best_t, sure_t, n_t)]
    rows += [(t, k, LANGUAGES[b], float(s), int(c), named[t], mixed[t]) for t, k, b, s, c in zip(block_text.tolist(), block[by_block].tolist(), best, sure, n)]
    return rows


def _identified(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, fit(sample_of(docs, "doc_id", "text", "lang")), "doc_id", "text", "lang")


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Texts whose label is missing or wrong, and all blocks of texts in several languages."""
    case = ((F.col("block_no") == 0) & ~F.col("labelled").eqNullSafe(F.col("lang"))) | ((F.col("block_no") > 0) & F.col("mixed"))
    return _identified(spark, sf_dir).where(case).select(F.col("id").alias("doc_id"), "block_no", "lang")


def p9_languages(spark, sf_dir: str) -> DataFrame:
    """Language and confidence of every text and every block of a mixed text."""
    found = _identified(spark, sf_dir).where("block_no = 0 or mixed")
    return found.select(F.col("id").alias("doc_id"), "block_no", "lang", F.round("confidence", 6).alias("confidence"), "letters", "labelled")


QUERIES = {"p9_found": p9_found, "p9_languages": p9_languages}
