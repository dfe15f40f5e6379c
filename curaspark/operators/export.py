"""Training-set export, file verification, reports."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def exportable(samples: DataFrame) -> DataFrame:
    """Golden and not rejected."""
    return samples.where(C.tagged(F.col("tags"), ["golden"], ["rejected"]))


def yolo_lines(dets: DataFrame, classes: DataFrame) -> DataFrame:
    """hash, src_path, pos, line of detections whose class has an index (label, idx); six decimals."""
    j = dets.join(F.broadcast(classes), "label")
    return j.select("hash", "src_path", "pos", F.format_string("%d %.6f %.6f %.6f %.6f", "idx", "cx", "cy", "w", "h").alias("line"))


def unknown_classes(dets: DataFrame, classes: DataFrame) -> DataFrame:
    """label, n of detections that an export skips."""
    return dets.join(F.broadcast(classes), "label", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def label_files(samples: DataFrame, lines: DataFrame, val_fraction: float = 0.0) -> DataFrame:
    """hash, split, name, body: one label file an image, names made unique with _1, _2 in order of path and hash."""
    stem = F.regexp_extract("src_path", r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    body = lines.groupBy("hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    named = samples.select("hash", "src_path", stem.alias("stem"))
    nth = F.row_number().over(Window.partitionBy("stem").orderBy("src_path", "hash")) - 1
    named = named.withColumn("nth", nth).withColumn("name", F.when(F.col("nth") == 0, F.col("stem")).otherwise(F.concat_ws("_", "stem", "nth")))
    # a numbered name may be another image's own: such a one carries its hash as well
    own = named.select(F.col("stem").alias("name")).distinct().withColumn("taken", F.lit(True))
    named = named.join(own, "name", "left").withColumn("name", F.when((F.col("nth") > 0) & F.coalesce("taken", F.lit(False)), F.concat_ws("_", "name", "hash")).otherwise(F.col("name")))
    out = named.join(body, "hash", "left").select("hash", "src_path", "name", F.coalesce("body", F.lit("")).alias("body"))
    if not val_fraction:
        return out.withColumn("split", F.lit("train"))
    # the first share of the rows in order of path: their rank by a range-partitioned sort, not one window over all
    cut = max(1, int(out.count() * val_fraction))
    first = out.select("hash").join(samples.select("hash", "src_path"), "hash").orderBy("src_path", "hash").limit(cut).select("hash", F.lit("val").alias("split"))
    return out.join(first, "hash", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def write_label_files(files: DataFrame, folder: str) -> int:
    """Write label files below a folder that every executor shares; each task writes its own rows, renaming when whole."""

    def save(rows):
        for r in rows:
            where = os.path.join(folder, "labels", r["split"])
            os.makedirs(where, exist_ok=True)
            path = os.path.join(where, f"{r['name']}.txt")
            with open(f"{path}.part", "w", encoding="utf-8") as f:
                f.write(r["body"] + ("\n" if r["body"] else ""))
            os.replace(f"{path}.part", path)

    files.select("split", "name", "body").foreachPartition(save)
    return files.count()


def data_yaml(folder: str, names: list[str], has_val: bool) -> str:
    val = "images/val" if has_val else "images/train"
    return "\n".join([f"path: {folder}", "train: images/train", f"val: {val}", f"nc: {len(names)}", "names:", *[f"  {i}: {n}" for i, n in enumerate(names)], ""])


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, problem (mismatched, missing, unexpected) of files (path, sha256) against a manifest of the same shape."""
    j = manifest.select("path", F.col("sha256").alias("want")).join(files.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "mismatched")
    return j.withColumn("problem", problem).where("problem is not null").select("path", "problem")


# reports -------------------------------------------------------------------------


def health_json(row: dict) -> str:
    return json.dumps({k: (None if isinstance(v, float) and (v != v or abs(v) == float("inf")) else v) for k, v in row.items()}, ensure_ascii=False, indent=2, sort_keys=True, default=str)


def write_health(folder: str, row: dict, stamp: str) -> None:
    """health_report.json and .md, and the JSON again under history/ with its time."""
    os.makedirs(os.path.join(folder, "history"), exist_ok=True)
    text = health_json(row)
    pages = {"health_report.json": text, os.path.join("history", f"health_{stamp}.json"): text, "health_report.md": markdown_table("health", list(row), [tuple(row.values())])}
    for name, body in pages.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(body)


def markdown_table(title: str, columns: list[str], rows: list[tuple]) -> str:
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows], ""])


def html_table(title: str, columns: list[str], rows: list[tuple]) -> str:
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    head = "<tr>" + "".join(cell("th", c) for c in columns) + "</tr>"
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows)
    return f"<section><h2>{html.escape(title)}</h2><table>{head}{body}</table></section>"


def weakness_report(folder: str, sections: dict[str, DataFrame], limit: int = 50) -> list[str]:
    """report.md and report.html, which show each section as far as ``limit`` rows, and a folder of CSV files with all its rows."""
    os.makedirs(folder, exist_ok=True)
    md, page = [], []
    for title, df in sections.items():
        rows = [tuple(r) for r in df.limit(limit).collect()]
        md.append(markdown_table(title, df.columns, rows))
        page.append(html_table(title, df.columns, rows))
        worklist_csv(df, os.path.join(folder, title))
    out = [os.path.join(folder, "report.md"), os.path.join(folder, "report.html")]
    with open(out[0], "w", encoding="utf-8") as f:
        f.write("\n".join(md))
    with open(out[1], "w", encoding="utf-8") as f:
        f.write("<!doctype html><meta charset=utf-8>" + "".join(page))
    return out


def worklist_csv(rows: DataFrame, path: str) -> None:
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True)
