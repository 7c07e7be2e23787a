"""How the tokens of two tokenizers lie over each other.

A text is cut before its spaces where neither tokenizer has a token over such a cut, so
that it is a sequence of units, and a task works each distinct unit out once. The tokens of new units become two
DuckDB tables of byte intervals. An ASOF join finds the B token under the first byte of an A
token, a range join the others it reaches into, and window sums over the offsets where
both begin number the groups; a second query adds units up to texts. Tasks count the
documents of each id pair among their own, Spark adds the partial counts up, and hands each
document the counts of its pairs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bounded_broadcast, chunks, drop_stash, settings, stash, table

#: Folder of the public vocabularies; a parameter of every function that reads it.
TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once; one document at least.
PIECE_BYTES = 2_000_000
#: Letters of units, with what a unit needs besides, that a task remembers.
UNIT_BYTES = 60_000_000
#: Rows that meet in one Arrow batch where pairs of documents are counted.
COUNTED_ROWS = 2_000

ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
_NEW = [c.split()[0] for c in ALIGNED.split(", ")]
_KINDS = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
_NOTHING = [0, 0, 0, 0, "", [], []]

#: a, b: token k of the new units, of unit doc, has this id and the bytes from begin to stop.
_STEPS = [
    """CREATE OR REPLACE TEMP TABLE met AS SELECT a.*, f.id AS under, f.stop AS until, f.begin = a.begin AS cut
        FROM a ASOF JOIN b AS f ON a.begin >= f.begin""",
    """CREATE OR REPLACE TEMP TABLE pairs AS SELECT doc, (x << 32) | y AS pair, count(*) AS n FROM (
        SELECT doc, id AS x, under AS y FROM met
        UNION ALL SELECT m.doc, m.id, b.id FROM (SELECT * FROM met WHERE until < stop) AS m JOIN b ON b.begin >= m.until AND b.begin < m.stop) GROUP BY ALL""",
    """CREATE OR REPLACE TEMP TABLE grouped AS
        SELECT doc, 0 AS side, k, id, sum(cut::INTEGER) OVER w AS g, lead(cut, 1, true) OVER w AS closes FROM met WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)
        UNION ALL SELECT doc, 1, k, id, sum(cut::INTEGER) OVER w, lead(cut, 1, true) OVER w
        FROM (SELECT b.*, m.begin IS NOT NULL AS cut FROM b LEFT JOIN (SELECT begin FROM met WHERE cut) AS m USING (begin)) WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)""",
]
_ADD = [
    """INSERT INTO units SELECT doc, count(*) FILTER (side = 0), count(*) FILTER (side = 1), count(*) FILTER (side = 0 AND closes),
        string_agg(id || CASE WHEN NOT closes THEN ',' WHEN side = 0 THEN '|' ELSE ';' END, '')[:-2] FROM (SELECT * FROM grouped ORDER BY g, side, k) GROUP BY doc""",
    "INSERT INTO unit_pairs SELECT * FROM pairs",
]
#: words: unit at place k of the text doc.
_RESULT = """
WITH texts AS (SELECT doc, sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b, sum(n_groups)::BIGINT AS n_groups, sha256(string_agg(t, ';')) AS groups_sha256
    FROM (SELECT * FROM words JOIN units USING (unit) ORDER BY k) GROUP BY doc),
together AS (SELECT doc, pair, sum(n * times)::BIGINT AS times FROM (SELECT doc, unit, count(*) AS times FROM words GROUP BY ALL) JOIN unit_pairs USING (unit) GROUP BY ALL),
linked AS (SELECT doc, sum(times)::BIGINT AS n_links, list(pair) AS pairs, list(times) AS times FROM together GROUP BY doc)
SELECT doc, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times FROM texts JOIN linked USING (doc) ORDER BY doc"""


class Vocabulary:
    """Token bytes by id."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        self.sizes = np.array([len(t or b"") for t in self.tokens])

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _visible_bytes() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def tokenizer_a(path: str):
    """(encode a list of texts, vocabulary); strings of special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    letters = _visible_bytes()
    tokens = {i: bytes(letters[c] for c in entry) for entry, i in own.get_vocab(with_added_tokens=False).items() if all(c in letters for c in entry)}
    return lambda found: [e.ids for e in own.encode_batch_fast([f" {t}" for t in found], add_special_tokens=False)], Vocabulary(tokens)


@cache
def tokenizer_b(path: str):
    """(encode a list of texts, vocabulary); it adds a space before each text itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    piece = lambda i: bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode()
    tokens = {i: piece(i) for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i))}
    return lambda found: own.encode(found, num_threads=1), Vocabulary(tokens)


def _intervals(ids: list[np.ndarray], first: int, vocabulary: Vocabulary) -> pa.Table:
    """The tokens of units first, first + 1, ...; units follow each other, so an offset belongs to one."""
    flat = np.concatenate(ids)
    stop = np.cumsum(vocabulary.sizes[flat])
    doc = np.repeat(np.arange(first, first + len(ids)), [len(x) for x in ids])
    return pa.table({"k": np.arange(len(flat)), "doc": doc, "id": flat, "begin": stop - vocabulary.sizes[flat], "stop": stop})


def _spelled(encode, vocabulary: Vocabulary, found: list[str]) -> list[np.ndarray | None]:
    """The tokens of every text; None where they do not spell it with a space before it."""
    out = []
    for text, ids in zip(found, encode(found)):
        try:
            out.append(np.array(ids) if vocabulary.joined(ids) == f" {text}".encode() else None)
        except (TypeError, IndexError):  # an id that stands for no bytes, as an unknown piece does
            out.append(None)
    return out


def _spelled_together(encode, vocabulary: Vocabulary, units: list[str], together: int = 500) -> list[np.ndarray | None]:
    """As `_spelled`, for units that may stand in a row with spaces between: many are encoded as one text."""
    groups = [units[i : i + together] for i in range(0, len(units), together)]
    out: list[np.ndarray | None] = []
    for group, ids in zip(groups, _spelled(encode, vocabulary, [" ".join(g) for g in groups])):
        if ids is not None:
            stops, ends = np.cumsum(vocabulary.sizes[ids]), np.cumsum([len(u.encode()) + 1 for u in group])
            at = np.searchsorted(stops, ends)
            if (stops[at] == ends).all():
                stop = [0, *(at + 1).tolist()]
                out += [ids[i:j] for i, j in pairwise(stop)]
                continue
        out += _spelled(encode, vocabulary, group)
    return out


class Aligner:
    """Tables of the units that were met, in a database in memory with one thread, which never writes to a local folder."""

    def __init__(self, tokenizers: str = TOKENIZERS):
        self.con = duckdb.connect(config={"threads": "1", "temp_directory": "", "autoinstall_known_extensions": "false"})
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = tokenizer_a(f"{tokenizers}/{A_FILE}"), tokenizer_b(f"{tokenizers}/{B_FILE}")
        # Before these letters and a space nothing is cut: some token lies over it.
        spanning = [t for v in (self.bytes_a, self.bytes_b) for t in v.tokens if t and b" " in t.lstrip(b" ")]
        self.uncut = {"  "} | {a + b for t in spanning for a, b in pairwise(t.decode(errors="replace")) if b == " "}
        self.before = tuple(x[0] for x in self.uncut)
        self._forget()

    def _forget(self) -> None:
        self.units: dict[str, int] = {}
        self.held = self.made = 0
        self.con.execute("CREATE OR REPLACE TEMP TABLE units (unit BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, t VARCHAR)")
        self.con.execute("CREATE OR REPLACE TEMP TABLE unit_pairs (unit BIGINT, pair BIGINT, n BIGINT)")

    def _units_of(self, text: str) -> list[str]:
        """Cut before every space; a text in which a token may lie over one is a unit as a whole."""
        return [text] if text[0] == " " or text[-1] == " " or any(x in text for x in self.uncut) else text.split(" ")

    def _meet(self, found: list[str]) -> None:
        """Work out units that are new. Those that the tokens of A or B do not spell get the number -1."""
        new = [u for u in dict.fromkeys(found) if u not in self.units]
        alone = [u for u in new if " " in u or u.endswith(self.before)]
        rows = [u for u in new if not (" " in u or u.endswith(self.before))]
        ids = [[*_spelled(e, v, alone), *_spelled_together(e, v, rows)] for e, v in ((self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b))]
        spelled = [(u, a, b) for u, a, b in zip([*alone, *rows], *ids) if a is not None and b is not None]
        self.units.update(dict.fromkeys(new, -1))
        self.units.update((u, self.made + k) for k, (u, _, _) in enumerate(spelled))
        self.held += sum(map(len, new)) + 100 * len(new)
        if not spelled:
            return
        self.con.register("a", _intervals([a for _, a, _ in spelled], self.made, self.bytes_a))
        self.con.register("b", _intervals([b for _, _, b in spelled], self.made, self.bytes_b))
        self.made += len(spelled)
        for step in [*_STEPS, *_ADD]:
            self.con.execute(step)
        self.con.unregister("a")
        self.con.unregister("b")

    def _numbers(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        flat = list(chain.from_iterable(words))
        self._meet(flat)
        return np.repeat(np.arange(len(words)), [len(own) for own in words]), np.fromiter(map(self.units.__getitem__, flat), np.int64, len(flat))

    def align(self, found: list[str]) -> pa.Table:
        """One row a text, none of them empty, that has tokens: doc (its place in the list) and the columns of ALIGNED."""
        if self.held > UNIT_BYTES:
            self._forget()
        words = [self._units_of(t) for t in found]
        doc, unit = self._numbers(words)
        if (unit < 0).any():
            # A text with a unit that is not spelled is looked at as a whole, and left out if it is not spelled either.
            for i in np.unique(doc[unit < 0]).tolist():
                words[i] = [found[i]]
            doc, unit = self._numbers(words)
            doc, unit = doc[unit >= 0], unit[unit >= 0]
        self.con.register("words", pa.table({"doc": doc, "unit": unit, "k": np.arange(len(unit))}))
        out = self.con.sql(_RESULT).to_arrow_table()
        self.con.unregister("words")
        return out


def _align(batches: Iterator[pa.RecordBatch], tokenizers: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(tokenizers)
    for batch in chunks(batches, budget=PIECE_BYTES):
        rows = batch.column("text").to_pylist()
        distinct = {t: i for i, t in enumerate(dict.fromkeys(t for t in rows if t))}
        made = aligner.align(list(distinct))
        at = {d: i for i, d in enumerate(made.column("doc").to_pylist())}
        # Texts without tokens take the row after the last.
        place = pa.array([at.get(distinct.get(t), len(at)) for t in rows])
        columns = [batch.column(n) for n in batch.schema.names if n != "text"]
        for name, kind, nothing in zip(_NEW, _KINDS, _NOTHING):
            columns.append(pa.concat_arrays([*[c.cast(kind) for c in made.column(name).chunks], pa.array([nothing], kind)]).take(place))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = duckdb.connect(config={"threads": "1", "temp_directory": ""})
    for batch in batches:
        con.register("docs", pa.Table.from_batches([batch]))
        yield from con.sql("SELECT pair, count(*)::BIGINT AS n FROM (SELECT unnest(pairs) AS pair FROM docs) GROUP BY pair").to_arrow_table().to_batches()
        con.unregister("docs")


def align(docs: DataFrame, text: str = "text", tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs), two written tables.

    documents: row (a number), whole (the columns of docs but the text) and ALIGNED: pairs are the id pairs
    (A << 32 | B) that a document links, times how many links each has. pairs: pair, n
    (the documents that link it), best (whether n is the highest of its A id, ties included).

    Null and empty texts, and texts that the tokens of A or B do not spell byte for byte, have no tokens:
    zeros, empty lists, and '' for the digest. Repeated rows are documents of their own.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    # A number holds once it is written, and nothing is joined by it before.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*rest, F.lit(0).alias("__")).alias("whole"), F.col(text).alias("text"))
    schema = StructType([f for f in rows.schema if f.name != "text"] + StructType.fromDDL(ALIGNED).fields)
    arrow = to_arrow_schema(schema)
    documents = stash(rows.mapInArrow(lambda batches: _align(batches, tokenizers, arrow), schema), "aligned")
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(COUNTED_ROWS)}):
        partial = documents.select("pairs").mapInArrow(_count, "pair bigint, n bigint")
        counts = stash(partial.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    # One row an A id at most.
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    best = counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    pairs = stash(best, "pairs")
    drop_stash(counts)
    return documents, pairs


def scored(docs: DataFrame, text: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """docs without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best counts the links whose pair is linked in as many documents as any of its A id;
    count_sum adds up, over all links, the documents that link their pair. Odd rows are
    as in `align`; other columns of docs with these names are replaced.
    """
    named = [*_NEW[:5], "n_best", "count_sum"]
    documents, pairs = align(docs.drop(*[c for c in docs.columns if c.lower() in named and c != text]), text, tokenizers)
    links = documents.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(bounded_broadcast(pairs), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    rest = [F.col(f"whole.`{c}`") for c in documents.schema["whole"].dataType.names[:-1]]
    zero = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "count_sum")]
    return documents.drop("pairs", "times").join(sums, "row", "left").select(*rest, *_NEW[:4], *zero, "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its token and link counts; see scored for odd rows."""
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
