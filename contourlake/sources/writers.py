"""Writers: manifests, results with upsert, keys and self-contained listening forms."""

from __future__ import annotations

import base64
import html
import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S


def training_manifest(rows: DataFrame, path: str) -> None:
    """JSON lines of id, audio_path, text, language_id and duration."""
    rows.select("id", "audio_path", "text", "language_id", F.round("duration", 3).alias("duration")).write.mode("overwrite").json(path)


def results(rows: DataFrame, path: str, heavy: Sequence[str] = ("pairs", "wav")) -> None:
    """Results without heavy columns."""
    rows.drop(*heavy).write.mode("overwrite").json(path)


def upserted(old: DataFrame, new: DataFrame, key: str = "run_tag") -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(rows: DataFrame, path: str, key: str = "run_tag") -> None:
    """Replaces a run's partition and leaves the others alone; the same run written again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_partition(rows: DataFrame, path: str, keys: Sequence[str] = ("budget", "seed")) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def keymap_json(items: DataFrame, item: str = "item_id") -> DataFrame:
    """One row: the key as a JSON map, numbers rounded, NaN as null."""
    numbers = {c: S.rounded(F.col(c)) for c, t in items.dtypes if t == "double"}
    rounded = items.withColumns(numbers) if numbers else items
    fields = F.struct(*(c for c in items.columns if c != item))
    return rounded.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(item, fields)))), {"ignoreNullFields": "false"}).alias("json"))


def keymap(items: DataFrame, path: str, item: str = "item_id") -> None:
    """The key as JSON lines, a one-entry map of item to fields each, numbers rounded, NaN as null; of any size, since no row holds them all. ``keymap_json`` is for a kit's form."""
    numbers = {c: S.rounded(F.col(c)) for c, t in items.dtypes if t == "double"}
    rounded = items.withColumns(numbers) if numbers else items
    fields = F.struct(*(c for c in items.columns if c != item))
    rounded.select(F.to_json(F.create_map(F.col(item), fields), {"ignoreNullFields": "false"}).alias("json")).write.mode("overwrite").text(path)


def data_uri(audio, kind: str = "audio/wav"):
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(audio))


def audio_uri(wav: bytes, encode: Callable[[bytes], bytes] | None = None) -> str:
    """A data URI of a clip: compressed by encode where there is such a codec and it works, else the wave itself."""
    if encode is not None:
        try:
            return "data:audio/mpeg;base64," + base64.b64encode(encode(wav)).decode()
        except (OSError, ValueError):
            pass
    return "data:audio/wav;base64," + base64.b64encode(wav).decode()


#: Shared by both forms: the compact code, and the answers as a file.
ANSWERS_JS = """function show() {{ document.getElementById('code').textContent = ['{code}', ...Object.entries(said).map(([k, v]) => k + '=' + v)].join(';'); }}
function save() {{
  const lines = ['item_id,answer', ...Object.entries(said).map(([k, v]) => k + ',' + v)];
  const a = document.createElement('a');
  a.href = URL.createObjectURL(new Blob([lines.join('\\n')], {{type: 'text/csv'}}));
  a.download = 'responses.csv';
  a.click();
}}
document.getElementById('save').onclick = save;
"""


def form(items: DataFrame, labels: Sequence[str], title: str, code: str = "PILOT1") -> str:
    """A page that needs nothing else: plays each item, keeps one label for each, shows the compact code and gives a CSV. items(item_id, text, audio as data URI), or for A/B trials (item_id, text, audio_a, audio_b), is a kit, some dozens of rows."""
    names = [c for c in ("item_id", "text", "audio", "audio_a", "audio_b") if c in items.columns]
    rows = [r.asDict() for r in items.select(*names).toLocalIterator()]
    data = json.dumps(rows, ensure_ascii=False).replace("</", "<\\/")
    players = [c for c in names if c.startswith("audio")]
    add = "".join(f"  row.append(Object.assign(document.createElement('span'), {{textContent: '{c[6:].upper()}'}}));\n" * (len(players) > 1) + f"  row.append(Object.assign(document.createElement('audio'), {{src: it.{c}, controls: true}}));\n" for c in players)
    script = (
        f"const ITEMS = {data};\nconst LABELS = {json.dumps(list(labels))};\nconst said = {{}};\n"
        "const list = document.getElementById('items');\n"
        "for (const it of ITEMS) {\n"
        "  const row = document.createElement('section');\n"
        "  row.append(Object.assign(document.createElement('p'), {textContent: it.text}));\n"
        f"{add}"
        "  for (const name of LABELS) {\n"
        "    const b = Object.assign(document.createElement('button'), {textContent: name});\n"
        "    b.onclick = () => { said[it.item_id] = name; show(); };\n"
        "    row.append(b);\n"
        "  }\n"
        "  list.append(row);\n"
        "}\n" + ANSWERS_JS.format(code=code)
    )
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><div id="items"></div><button id="save">CSV</button><pre id="code"></pre><script>{script}</script></body></html>'


def upload(files: DataFrame, folder: str, path: str = "path", content: str = "content") -> DataFrame:
    """Writes each row's bytes to its path under a folder of any store that Arrow knows, each task its own rows; path and bytes of what was written. A task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        for b in batches:
            sizes = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = f"{root}/{name}"
                store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(to) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "path string, bytes long")


def shards(rows: DataFrame, path: str, n: int, seed: int, key: str = "id") -> None:
    """n files of training rows, dealt out by a hash of their key."""
    placed = rows.withColumn("_s", S.hash_number(F.lit(seed), F.col(key)))
    placed.repartition(n, "_s").drop("_s").write.mode("overwrite").json(path)


def tee(lines: DataFrame, path: str, pattern: str) -> DataFrame:
    """Writes the whole log, and gives the lines that match."""
    lines.write.mode("overwrite").text(path)
    return lines.where(F.col("value").rlike(pattern))


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """What a plot needs: bin, its left edge and count."""
    b = F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(bins))
    return rows.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("left", F.lit(lo) + (F.col("bin") - 1) * ((hi - lo) / bins))
