"""Fill-in-middle: texts cut at two ranks of an indexable skip list and put together in another order.

The list's nodes are a text's units (lines). Every lane of the list has nodes with two widths: the units and the code
points from it to the next node of the lane. To reach a rank, one descends from the widest lane, going along a lane while
its next width doesn't pass the rank; the code points walked are then the cut's position. Cuts fall between units, so
none splits a line, and a long text is reached in about the logarithm of its units.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.catalog import query
from strandlake.llm.common import table
from strandlake.session import ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Seed of the draws, and of 100 documents so many that are rearranged, and of these so many whose suffix comes first.
SEED, RATE, SPM = 7, 100, 50
#: A node of one lane is one of the lane above with this chance.
RISE = 0.25


def unit_widths(text: str) -> np.ndarray:
    """Code points of each line, its line feed included; the last may lack one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.flatnonzero(points == 10) + 1
    if len(points) and (not len(ends) or ends[-1] != len(points)):
        ends = np.append(ends, len(points))
    return np.diff(ends, prepend=0)


class SkipList:
    """Units by their widths in code points; ``seed`` decides how many lanes a unit is in."""

    def __init__(self, widths: np.ndarray, seed: int):
        self.units, self.points = len(widths), int(widths.sum())
        # Lane 0 has all nodes, the head among them. A lane is (unit widths, code-point widths, place of each node in the lane below).
        ones = np.ones(len(widths), dtype=np.int64)
        self.lanes = [(ones, np.asarray(widths, dtype=np.int64), np.arange(len(widths)))]
        draws = np.random.default_rng(seed).random(2 * len(widths) + 64)
        used = 0
        while len(self.lanes[-1][0]) > 1:
            steps, points, _ = self.lanes[-1]
            drawn = draws[used : used + len(steps)]
            used += len(steps)
            up = drawn < RISE if len(drawn) == len(steps) else np.zeros(len(steps), dtype=bool)
            up[0] = True  # the head stands in every lane
            if up.all():
                break
            places = np.flatnonzero(up)
            self.lanes.append((np.add.reduceat(steps, places), np.add.reduceat(points, places), places))

    def position(self, rank: int) -> int:
        """Code points before the unit of this rank; the rank may be the number of units."""
        if not 0 <= rank <= self.units:
            raise IndexError(f"rank {rank} of {self.units}")
        if rank == self.units:
            return self.points
        place, units, points = 0, 0, 0
        for steps, widths, below in reversed(self.lanes):
            while place < len(steps) and units + steps[place] <= rank:
                units += int(steps[place])
                points += int(widths[place])
                place += 1
            place = int(below[place])
        return points


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def rearranged(text: str, numbers: tuple[int, int, int, int], rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """``(units, form, prefix's code points, middle's code points, output)``."""
    widths = unit_widths(text)
    n = len(widths)
    if not text or any(m in text for m in MARKS) or numbers[2] % 100 >= rate:
        return n, "plain", None, None, text
    units = SkipList(widths, numbers[0])
    a, b = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    a, b = units.position(a), units.position(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if numbers[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that ``rearranged`` was given; no part holds a mark, so each is where it first occurs."""
    if form == "plain":
        return output
    opening, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    first, rest = output.removeprefix(opening).split(second, 1)
    other, middle = rest.split(MIDDLE, 1)
    return first + middle + other if form == "psm" else other + middle + first


def transform(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` is the number of lines; ``form`` is plain, psm or spm. A null or empty text and one that holds a mark is plain:
    the text as it is, null as empty. Rows that repeat an id get the same draws, a null id those of an empty one; an
    empty table gives no rows. Columns other than doc_id and text are not read.
    """
    return _mapped(docs, [("output", pa.string(), "string", lambda output, form: output)], rate, spm, seed)


def _mapped(docs: DataFrame, last: list, rate: int, spm: int, seed: int) -> DataFrame:
    """Rows of ``transform`` whose last columns are functions of output and form: (name, Arrow type, SQL type, function)."""
    ship_package(docs.sparkSession)
    facts = [("n", pa.int64(), "long"), ("form", pa.string(), "string"), ("prefix_chars", pa.int64(), "long"), ("middle_chars", pa.int64(), "long")]

    def rewrite(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                *known, output = rearranged(text.as_py() or "", draws(doc_id.as_py(), seed), rate, spm)
                rows.append((*known, *[f(output, known[1]) for *_, f in last]))
            types = [t for _, t, _ in facts] + [t for _, t, _, _ in last]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *[f[0] for f in facts], *[x[0] for x in last]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{n} {s}" for n, s in [(f[0], f[2]) for f in facts] + [(x[0], x[2]) for x in last])
    return docs.select("doc_id", "text").mapInArrow(rewrite, f"doc_id {kind}, {fields}")


def digest(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """``transform`` with the output's hash instead of the output, and the hash of the text rebuilt from it."""
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    hashes = [
        ("output_sha256", pa.string(), "string", lambda output, form: sha(output)),
        ("restored_sha256", pa.string(), "string", lambda output, form: sha(restored(output, form))),
    ]
    return _mapped(docs, hashes, rate, spm, seed)


def _sql() -> str:
    number = lambda i: f"CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * i + 1}, 8) AS BIGINT)"
    held = " OR ".join(f"contains(body, '{m}')" for m in MARKS)
    return rf"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS body, {', '.join(f'{number(i)} AS h{i + 1}' for i in range(4))} FROM documents),
             lines AS (SELECT *, regexp_extract_all(body, '[^\n]*\n|[^\n]+') AS units FROM docs),
             cuts AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
                      CASE WHEN body = '' OR {held} OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM lines),
             parts AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:], ''), '') AS s FROM cuts)
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
               sha256(CASE WHEN form = 'plain' THEN body ELSE p || m || s END) AS restored_sha256
        FROM parts
    """


@query("op12_skip_list_middle", _sql())
def run(spark, sf_dir):
    return digest(table(spark, sf_dir, "documents"))
