"""The jobs: against plain versions, repeated, and over growing input."""

import logging
import math
import random
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from jobs import queries, text_styles, tile_map
from tests.test_queries import rows

ROOT = Path(__file__).resolve().parents[1]
PLAIN = tile_map.CONFIG | {"table": "scans", "cloud_id": "cloud", "pid": "pid", "levels": [{"x": "px", "y": "py", "z": "pz"}], "voxel": 0.5, "tile": 4, "thickness": 0.1}
SCANS = "cloud string, pid long, px double, py double, pz double, n int, tile string, code string, i int"


def scan(name, n, seed):
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(-3, 3, (n, 3)) * [1, 1, 0.001 if name == "flat" else 1]
    return [(name, k, *map(float, p), 1, "t", "c", 2) for k, p in enumerate(xyz)]


def save(spark, data, schema, path):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(path))


def collected(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def plain_map(data):
    out = {}
    for cloud in {r[0] for r in data}:
        xyz = np.array([r[2:5] for r in data if r[0] == cloud and r[1] is not None and None not in r[2:5] and all(map(math.isfinite, r[2:5]))])
        cell = np.floor((xyz - xyz.min(0)) / 0.5 + 0.5).astype(int)
        for c in {tuple(x) for x in cell.tolist()}:
            out[(cloud, c)] = (int((cell == c).all(1).sum()), xyz[(cell == c).all(1)].mean(0))
    return out


def test_tile_map(spark, tmp_path, caplog):
    data = scan("flat", 400, 1) + scan("2020-01-01", 300, 2)
    wrong = [("flat", None, 0.0, 0.0, 0.0), ("flat", 900, None, 0.0, 0.0), ("flat", 901, float("nan"), 0.0, 0.0), ("flat", 902, 0.0, float("inf"), 0.0)]
    save(spark, data + [(*w, 1, "t", "c", 2) for w in wrong], SCANS, tmp_path / "scans.parquet")
    caplog.set_level(logging.INFO)
    got = tile_map.run(spark, str(tmp_path), f"{tmp_path}/map", PLAIN)
    want = plain_map(data)
    assert "read 700 points" in caplog.text and f"wrote {len(want)} points" in caplog.text
    first = got.collect()
    assert sorted((r["cloud_id"], r["n"], round(r["x"], 9), round(r["y"], 9), round(r["z"], 9)) for r in first) == sorted((k[0], n, *(round(float(v), 9) for v in m)) for k, (n, m) in want.items())
    # the plane of each tile is that of its points
    by_tile = defaultdict(list)
    for r in first:
        by_tile[r["cloud_id"], r["tile"]].append(r)
    assert max(map(len, by_tile.values())) <= 4**3 and len(by_tile) > 10
    for (cloud, _), members in by_tile.items():
        xyz = np.array([[r["x"], r["y"], r["z"]] for r in members])
        values, axes = np.linalg.eigh(np.cov(xyz.T, bias=True)) if len(xyz) > 1 else (np.zeros(3), np.eye(3))
        normal = np.array([members[0]["nx"], members[0]["ny"], members[0]["nz"]])
        assert members[0]["planar"] == (len(xyz) >= 3 and bool(values[0] <= 0.01))
        if len(xyz) >= 4 and values[1] > 1e-3 * values[2]:
            assert abs(normal @ axes[:, 0]) > 1 - 1e-6 and normal @ xyz.mean(0) <= 1e-9
        elif len(xyz) < 3:
            assert normal.tolist() == [0, 0, 1]
    # again: the same; one cloud anew: the others stay
    assert collected(tile_map.run(spark, str(tmp_path), f"{tmp_path}/map", PLAIN)) == sorted(tuple(r[c] for c in sorted(got.columns)) for r in first)
    save(spark, scan("flat", 50, 9) + scan("2020-01-01", 50, 9), SCANS, tmp_path / "more" / "scans.parquet")
    after = tile_map.run(spark, f"{tmp_path}/more", f"{tmp_path}/map", PLAIN | {"clouds": ["flat"]}).collect()
    assert sum(r["n"] for r in after if r["cloud_id"] == "flat") == 50
    assert sorted(r for r in after if r["cloud_id"] != "flat") == sorted(r for r in first if r["cloud_id"] != "flat")


def test_tile_map_of_nothing(spark, tmp_path):
    save(spark, [], SCANS, tmp_path / "scans.parquet")
    assert tile_map.run(spark, str(tmp_path), f"{tmp_path}/map", PLAIN).collect() == []


def test_box_readers_skip_files(spark, tmp_path):
    """Files hold ranges of tiles."""
    save(spark, scan("wide", 3000, 4), SCANS, tmp_path / "scans.parquet")
    tile_map.run(spark, str(tmp_path), f"{tmp_path}/map", PLAIN | {"files": 6, "voxel": 0.25})
    ranges = [duckdb.sql(f"SELECT min(tile), max(tile) FROM '{p}'").fetchall()[0] for p in Path(tmp_path, "map").rglob("*.parquet")]
    assert len(ranges) >= 4 and all(a[1] <= b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:]))


TEXTS = "doc_id long, text string, lang string, source string, bin int, n int, batch int, whole int"


def texts(n, seed):
    rng = random.Random(seed)
    # two names of one feed, and others of their own
    kinds = {"a": 3, "mirror of a": 3, "b": 6, "c": 10, None: 14}
    out = []
    for k in range(n):
        source = rng.choice(list(kinds))
        out.append((k, " ".join("é" * max(1, int(rng.gauss(kinds[source], 1))) for _ in range(rng.randrange(30))), rng.choice(["de", "en", None]), source, 1, 2, 3, 4))
    return out + [(n, None, "en", "b", 1, 2, 3, 4), (n + 1, "", "en", "c", 1, 2, 3, 4), (n + 2, " \t", "xx", "alone", 1, 2, 3, 4)]


def plain_report(data):
    hist = defaultdict(Counter)
    for _, text, lang, source, *_ in data:
        words = (text or "").split()
        for i, w in enumerate(words):
            hist[lang or "(none)", source or "(none)"][(min(len(w), 16) - 1) * 12 + 12 * i // len(words)] += 1
    out = []
    for lang in {k[0] for k in hist}:
        h = {s: {b: n / sum(c.values()) for b, n in c.items()} for (x, s), c in hist.items() if x == lang}
        chi = lambda a, b: sum((a.get(k, 0) - b.get(k, 0)) ** 2 / (a.get(k, 0) + b.get(k, 0)) for k in a.keys() | b.keys())
        d = {(s, t): chi(h[s], h[t]) for s in h for t in h if s != t}
        of = lambda s: sorted((d[s, t], t) for t in h if t != s)
        for s in h:
            for t in h:
                if s < t and of(s)[0][1] == t and of(t)[0][1] == s:
                    second = [min(2.0, of(x)[1][0]) if len(h) > 2 else 2.0 for x in (s, t)]
                    out.append((lang, s, t, round(d[s, t], 6), round(math.sqrt((1 - d[s, t] / second[0]) * (1 - d[s, t] / second[1])), 6)))
    return sorted(out)


def rounded(df):
    return sorted((r["lang"], r["source"], r["like"], round(r["distance"], 6), round(r["confidence"], 6)) for r in df.collect())


def test_text_styles_over_growing_input(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    table, out = tmp_path / "documents.parquet", f"{tmp_path}/styles"
    first, second = texts(120, 1), texts(150, 2)
    save(spark, first, TEXTS, table)
    assert rounded(text_styles.run(spark, str(tmp_path), out)) == plain_report(first)
    save(spark, second, TEXTS, table)
    caplog.clear()
    got = rounded(text_styles.run(spark, str(tmp_path), out))
    assert f"read {len(second)} new texts" in caplog.text  # not the first ones again
    assert got == plain_report(first + second)
    assert any(r[1:3] == ("a", "mirror of a") and r[4] > 0.5 for r in got)
    # nothing new, then a batch that was written but not committed
    assert rounded(text_styles.run(spark, str(tmp_path), out)) == got
    last = max(Path(out, "checkpoint", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    assert rounded(text_styles.run(spark, str(tmp_path), out)) == got


def test_text_styles_of_batches_and_of_nothing(spark, tmp_path):
    table = tmp_path / "documents.parquet"
    save(spark, [], TEXTS, table)
    assert text_styles.run(spark, str(tmp_path), f"{tmp_path}/none").collect() == []
    parts = [texts(40, k) for k in range(3)]
    for p in parts:
        save(spark, p, TEXTS, table)
    got = text_styles.run(spark, str(tmp_path), f"{tmp_path}/styles", text_styles.CONFIG | {"files_per_batch": 1})
    assert rounded(got) == plain_report([r for p in parts for r in p])
    assert len(list(Path(tmp_path, "styles", "counts").glob("batch=[0-9]*"))) >= 3


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_are_their_sql(spark, sf_dir, name):
    for p in Path(sf_dir).glob("*.parquet"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {p.stem} AS SELECT * FROM '{p}'")
    before = dict(spark.conf.getAll) if hasattr(spark.conf, "getAll") else None
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duckdb.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert rows(got) == rows(want)
    assert before is None or dict(spark.conf.getAll) == before


def test_command_lines(sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path)
    (tmp_path / "c.json").write_text('{"voxel": 0.2, "clouds": ["click"]}')
    done = subprocess.run([sys.executable, "-m", "jobs.tile_map", str(tmp_path), f"{tmp_path}/map", f"{tmp_path}/c.json"], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0 and "points of" in done.stderr, done.stderr[-2000:]
    assert {p.name for p in Path(tmp_path, "map").glob("cloud_id=*")} <= {"cloud_id=click"}
    shutil.copy(f"{sf_dir}/documents.parquet", tmp_path)
    for k in range(2):
        done = subprocess.run([sys.executable, "-m", "jobs.text_styles", str(tmp_path), f"{tmp_path}/styles"], cwd=ROOT, capture_output=True, text=True)
        assert done.returncode == 0 and f"read {0 if k else 200} new texts" in done.stderr, done.stderr[-2000:]
    for job in ("tile_map", "text_styles"):
        assert subprocess.run([sys.executable, "-m", f"jobs.{job}", "x"], cwd=ROOT, capture_output=True).returncode == 1


def test_jobs_need_no_text_operators():
    for p in [*Path(ROOT, "jobs").glob("*.py"), Path(__file__)]:
        lines = [x for x in p.read_text().splitlines() if "import " in x]
        assert not any("llm" in x or "corpus_pipeline" in x for x in lines), p
