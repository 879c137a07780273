"""Where results go: reports, routed tables, versioned profiles, cache entries, and a readable summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = ("path", "destination", "classification", "score", "reasoning")
AGAIN = ("source", "was", "now", "classification", "score", "reasoning", "is_error_fallback", "error_type", "retry_count", "burst_id")


#: Texts are kept as they are, blanks and line ends included; CSV has no empty text beside the missing one.
CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


#: Times keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[F.col(n).cast("string").alias(n) if n in have else F.lit(None).cast("string").alias(n) for n in names])


def write_short_report(results: DataFrame, path: str) -> None:
    _columns(results, SHORT).write.mode("overwrite").options(**CSV).csv(path)


def write_reprocessing_report(results: DataFrame, path: str) -> None:
    _columns(results, AGAIN).write.mode("overwrite").options(**CSV).csv(path)


def append_version(profile: DataFrame, path: str) -> None:
    """Profiles are never overwritten; ``profiles.current`` picks the newest version."""
    profile.write.mode("append").parquet(path)


def append_sessions(sessions: DataFrame, path: str) -> None:
    """A save of training sessions; saves are appended and ``profiles.latest_sessions`` picks each one's last."""
    sessions.write.mode("append").options(**_JSON).json(path)


def append_feedback(feedback: DataFrame, path: str) -> None:
    """Corrections as they are submitted: file_path, correct_category, reasoning, submitted_at."""
    feedback.select("file_path", "correct_category", "reasoning", "submitted_at").write.mode("append").options(**_JSON).json(path)


def write_export(results: DataFrame, path: str) -> None:
    """Every column of the results as CSV; list columns are joined by commas, other nested ones are JSON."""
    def flat(name: str, kind: str):
        if kind == "array<string>":
            return F.concat_ws(",", name).alias(name)
        nested = kind.startswith(("array", "map", "struct"))
        return (F.to_json(name) if nested else F.col(name).cast("string")).alias(name)

    results.select(*[flat(n, k) for n, k in results.dtypes]).write.mode("overwrite").options(**CSV).csv(path)


def append_cache(entries: DataFrame, path: str) -> None:
    """(store, key, reply, size_bytes, created_at, error_type): failures are not kept, so that they are tried again."""
    kept = entries.where(F.col("reply").isNotNull() & F.col("error_type").isNull())
    kept.write.mode("append").partitionBy("store").parquet(path)


def transferred(files: DataFrame, source: str, target: str, move: bool = False) -> DataFrame:
    """(source, target, outcome) for files copied, or moved, in the tasks; paths must be those of a file system that all
    executors mount. outcome: done, there (the target is there already, as after a task that ran again), missing, or the
    error. One file's failure stops no other. The result is lazy: nothing moves until it is read, and it should be
    written down."""
    def run(batches):
        import os
        import shutil
        import uuid

        import pandas as pd

        for b in batches:
            said = []
            for a, z in zip(b[source], b[target]):
                try:
                    if not os.path.exists(a):
                        said.append("there" if move and os.path.exists(z) else "missing")
                    elif os.path.exists(z) and os.path.getsize(z) == os.path.getsize(a) and not move:
                        said.append("there")
                    else:
                        os.makedirs(os.path.dirname(z), exist_ok=True)
                        part = f"{z}.{uuid.uuid4().hex}.part"  # whole or not at all
                        shutil.copy2(a, part)
                        os.replace(part, z)
                        if move:
                            os.remove(a)
                        said.append("done")
                except OSError as error:
                    said.append(str(error))
            yield pd.DataFrame({"source": b[source], "target": b[target], "outcome": said})

    return files.select(source, target).mapInPandas(run, "source string, target string, outcome string")


def newest_entries(cache: DataFrame) -> DataFrame:
    """One entry per store and key, the one written last."""
    rest = [c for c in cache.columns if c not in ("store", "key")]
    best = cache.groupBy("store", "key").agg(F.max_by(F.struct(*rest), F.struct("created_at", "reply")).alias("e"))
    return best.select("store", "key", "e.*")


def summary(counts: DataFrame, top: DataFrame, errors: int, seconds: float, most: int = 10_000) -> str:
    """A text from a count table (destination, n, percent), five top rows (path, score, reason) and totals. Every
    destination is listed; a table of more than ``most`` is no summary and raises."""
    rows = counts.orderBy(F.desc("n"), "destination").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} destinations")
    lines = [f"{sum(r['n'] for r in rows)} results in {seconds:.1f} s, {errors} errors"]
    lines += [f"{r['destination']}: {r['n']} ({r['percent']:.1f}%)" for r in rows]
    lines += [f"{k}. {r['path']} ({r['score']}/5) {r['reason'] or ''}".rstrip() for k, r in enumerate(top.limit(5).collect(), 1)]
    return "\n".join(lines)
