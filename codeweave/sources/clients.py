"""External services behind functions that the caller supplies: page reading, code extraction, text encoding.

Each runs in tasks, batch by batch, so a lost executor repeats only its own batches. Tests use fakes; no service is called here.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncated
from ..operators import ingest, pages


def with_retries(call: Callable, attempts: int = 4, pause: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried up to `attempts` times with pauses of pause, 2 pause, ...; the last error is raised."""

    def run(*args):
        for n in range(1, attempts + 1):
            try:
                return call(*args)
            except Exception:
                if n == attempts:
                    raise
                sleep(pause * n)

    return run


#: Calls a second of the page reader and of the extractor, and calls after which a signed address is renewed.
READ_RATE, EXTRACT_RATE, SIGNED_FOR = 1 / 0.3, 1 / 0.2, 20
#: Tasks that share a rate.
LANES = 4


def paced(call: Callable, pause: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, begun `pause` seconds after its last beginning at the earliest."""
    begin = -float("inf")

    def run(*args):
        nonlocal begin
        sleep(max(0.0, begin + pause - now()))
        begin = now()
        return call(*args)

    return run


def in_lanes(todo: DataFrame, lanes: int, rate: float | None) -> tuple[DataFrame, float]:
    """(todo in `lanes` partitions, the pause of each): so many tasks, each keeping its own pause, stay under `rate` calls a second together."""
    return (todo, 0.0) if rate is None else (todo.repartition(lanes), lanes / rate)


def read_pages(todo: DataFrame, read: Callable[[str, list[int]], list[str]], at_once: int = pages.SIZE, lanes: int = LANES, rate: float | None = READ_RATE, sign: Callable[[str], str] | None = None, signed_for: int = SIGNED_FOR) -> DataFrame:
    """(province, page, markdown) of the pages in todo (province, page), `at_once` pages of a province a call.

    At most `rate` calls a second, from `lanes` tasks. sign, if given, makes the address of a province that read gets in its place; it is
    renewed after signed_for calls.
    """
    numbered = F.struct(F.col("page").cast("int").alias("page"))
    calls = todo.groupBy("province", F.floor(F.col("page") / at_once).alias("call")).agg(F.sort_array(F.collect_set(numbered)).alias("pages"))  # at_once pages at most
    calls, pause = in_lanes(calls.select("province", F.col("pages.page").alias("pages")), lanes, rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(paced(read, pause))
        address = with_retries(sign) if sign else None
        signed: dict[str, tuple[str, int]] = {}
        for batch in batches:
            for province, numbers in zip(batch["province"], batch["pages"], strict=True):
                where, used = signed.get(province, (None, signed_for))
                if address is None:
                    where = province
                elif used >= signed_for:
                    where, used = address(province), 0
                signed[province] = (where, used + 1)
                part = [int(x) for x in numbers]
                yield pd.DataFrame({"province": province, "page": part, "markdown": call(where, part)})

    return calls.mapInPandas(run, "province string, page int, markdown string")


def extract_windows(texts: DataFrame, extract: Callable[[str], str], lanes: int = LANES, rate: float | None = EXTRACT_RATE) -> DataFrame:
    """(province, start, status, codes, chapter, section) of window texts (province, start, text); a failed call has the status failed and no codes.

    At most `rate` calls a second, from `lanes` tasks.
    """
    prompts = texts.select("province", F.col("start").cast("int").alias("start"), truncated(F.col("text"), ingest.MAX_PROMPT, ingest.MARKER).alias("prompt"))
    prompts, pause = in_lanes(prompts, lanes, rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(paced(extract, pause))
        for batch in batches:
            raw, status = [], []
            for prompt in batch["prompt"]:
                try:
                    raw.append(call(prompt))
                    status.append("done")
                except Exception:
                    raw.append(None)
                    status.append("failed")
            yield pd.DataFrame({"province": batch["province"], "start": batch["start"], "status": status, "raw": raw})

    return ingest.parsed_windows(prompts.mapInPandas(run, "province string, start int, status string, raw string")).drop("raw")


def hashed_vectors(texts: list[str], size: int = 64) -> np.ndarray:
    """A stand-in encoder without a model: signed token hashes summed up."""
    import zlib

    out = np.zeros((len(texts), size), dtype=np.float32)
    for i, t in enumerate(texts):
        for word in t.lower().split():
            h = zlib.crc32(word.encode())
            out[i, h % size] += 1 if h & (1 << 20) else -1
    return out


def embed(records: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray] = hashed_vectors, batch: int = 128) -> DataFrame:
    """(record_id, embedding): the texts' vectors at length 1, `batch` texts a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                v = np.asarray(encode(part["text"].tolist()), dtype=np.float32)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({"record_id": part["record_id"].to_numpy(), "embedding": list(v / np.where(norm > 0, norm, 1))})

    return records.select("record_id", F.coalesce(text, F.lit("")).alias("text")).mapInPandas(run, "record_id long, embedding array<float>")
