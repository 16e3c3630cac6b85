"""Quality rules: per-document statistics and cross-document line frequency.

Lines are normalised (ASCII lower case, single spaces) and hashed together with
their host.  The distinct documents of a host that hold a line are counted; exact
copies of a text count once.  Lines in more than ``LIMIT`` documents of their
host are removed, and a document is rejected if fewer than ``LEFT`` of its words
remain, or if it fails the base rules (under 20 words; over 30 % of its words in
8-word windows that occur twice).

Scale.  Each document emits its distinct line hashes once; counting is a partial
then a final sum, so a line that every document holds is one row a task.  Frequent
lines are few (at most all lines divided by ``LIMIT``) and are broadcast only while
there are at most ``BROADCAST`` of them; beyond that lines are joined by hash.
64-bit hashes: about n^2 / 2^65 colliding pairs among n distinct lines.

Cases.  Null or empty text has no words and fails the base rules.  A null host is
a host of its own, the empty name.  Repeated rows repeat.  Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, map_rows, per_worker

LIMIT = 30
LEFT = 0.3
BROADCAST = 500_000
WINDOW = 8
#: The symbols counted, and what stands between words.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
_SIGN = 1 << 63


class _Ids(dict):
    def __missing__(self, key):
        self[key] = out = len(self)
        return out


def repeated_words(words: list) -> int:
    """Words in windows of eight that occur at least twice in the text; windows are compared exactly.

    Ranks of windows of 2, 4 and 8 words come from pairs of ranks of half the size.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    rank = np.fromiter(map(_Ids().__getitem__, words), np.int64, n)
    width = 1
    while width < WINDOW:
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        _, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
        if count.max() < 2:
            return 0
        width *= 2
    starts = np.flatnonzero(count[rank] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


def _lines(host: str, text: str) -> list[tuple[int, int, str]]:
    """(signed hash with the host, words, line) of every line with a word."""
    mark, out = host.encode("utf-8") + b"\n", []
    for line in text.split("\n"):
        words = line.encode("utf-8").lower().split()
        if words:
            h = xxhash.xxh64_intdigest(mark + b" ".join(words))
            out.append((h - (1 << 64) if h >= _SIGN else h, len(words), line))
    return out


def frequent_lines(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """line: hashes of the lines in more than ``limit`` distinct documents of their host."""

    def work(rows: dict) -> dict:
        marks, lines = [], []
        for host, text in zip(rows["source"], rows["text"], strict=True):
            host, text = host or "", text or ""
            h = xxhash.xxh3_128_intdigest(host.encode("utf-8") + b"\n" + text.encode("utf-8"))
            marks.append(h.to_bytes(16, "big"))
            lines.append(list({x[0] for x in _lines(host, text)}))
        return {"text_hash": marks, "lines": lines}

    each = map_rows(docs, ["source", "text"], "text_hash binary, lines array<long>", work).filter(F.size("lines") > 0)
    once = each.groupBy("text_hash").agg(F.first("lines").alias("lines"))
    counts = once.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > limit).select("line")


def assess(docs: DataFrame, limit: int = LIMIT, left: float = LEFT, broadcast: int = BROADCAST, texts: bool = False) -> DataFrame:
    """Statistics, base_failed, n_removed_words and kept per row; ``texts`` adds text_left without the removed lines."""
    spark = docs.sparkSession
    often = cut(frequent_lines(docs, limit))
    names = ["doc_id", "source", "text"]
    if often.count() <= broadcast:
        sent, key = spark.sparkContext.broadcast(np.array([r["line"] for r in often.collect()], np.int64)), fresh("frequent-lines")

        def removed(rows: dict) -> list[set[int]]:
            known = per_worker(key, lambda: set(sent.value.tolist()))
            return [known] * len(rows["doc_id"])

        given = docs.select(*names)
    else:
        # too many to send: give each row the hashes of its own frequent lines, by joins on hash and row
        def hashes(rows: dict) -> dict:
            return {"row": rows["row"], "lines": [list({x[0] for x in _lines(s or "", t or "")}) for s, t in zip(rows["source"], rows["text"], strict=True)]}

        given = docs.select(*names, F.monotonically_increasing_id().alias("row"))
        given = cut(given)  # the ids must be the same in both uses
        own = map_rows(given, ["row", "source", "text"], "row long, lines array<long>", hashes).select("row", F.explode("lines").alias("line"))
        hit = own.join(often, "line", "left_semi").groupBy("row").agg(F.collect_list("line").alias("hit"))
        given = given.join(hit, "row", "left").select(*names, "hit")
        names = [*names, "hit"]

        def removed(rows: dict) -> list[set[int]]:
            return [set(x or ()) for x in rows["hit"]]

    def work(rows: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept", "text_left")}
        for host, text, gone in zip(rows["source"], rows["text"], removed(rows), strict=True):
            text = text or ""
            figures = statistics(text)
            for k, v in zip(out, figures, strict=False):
                out[k].append(v)
            lines = _lines(host or "", text) if gone else []
            n = sum(x[1] for x in lines if x[0] in gone)
            failed = base_failed(figures[0], figures[4])
            out["base_failed"].append(failed)
            out["n_removed_words"].append(n)
            out["kept"].append(not failed and figures[0] - n >= left * figures[0])
            out["text_left"].append(None if not texts else text if not n else "\n".join(x[2] for x in lines if x[0] not in gone))
        return {"doc_id": rows["doc_id"], **out}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_removed_words long, kept boolean, text_left string"
    found = map_rows(given, names, schema, work)
    return found if texts else found.drop("text_left")


def sql(limit: int = LIMIT, left: float = LEFT) -> str:
    """The same rules in DuckDB SQL."""
    return _SQL.replace("$LIMIT", str(limit)).replace("$LEFT", str(left)).replace("$MORE", str(WINDOW - 1))


_SQL = """
with d as (
  select row_number() over () as rid, doc_id, coalesce(source, '') as host, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
  from documents),
lines as (
  select rid, host, text, line, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as lw
  from (select rid, host, text, unnest(string_split(text, chr(10))) as line from d)),
worded as (select rid, host, text, line, array_to_string(lw, ' ') as norm, len(lw) as n from lines where len(lw) > 0),
often as (select host, norm from worded group by host, norm having count(distinct text) > $LIMIT),
gone as (select w.rid, sum(w.n) as n from worded w join often o on w.host = o.host and w.norm = o.norm group by w.rid),
dups as (select rid, count(*) - count(distinct line) as n from worded group by rid),
win as (select rid, i, array_to_string(ws[i : i + $MORE], ' ') as w from (select rid, ws, unnest(generate_series(1, len(ws) - $MORE)) as i from d)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, w) as c from win) where c > 1),
cover as (select rid, count(distinct i + j) as n from rep, generate_series(0, $MORE) s(j) group by rid),
f as (
  select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(dups.n, 0) as bigint) as n_dup_lines,
    cast(coalesce(cover.n, 0) as bigint) as n_repeat_words, cast(coalesce(gone.n, 0) as bigint) as n_removed_words
  from d left join dups using (rid) left join cover using (rid) left join gone using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed, n_removed_words,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - n_removed_words >= $LEFT * n_words as kept
from f
"""
