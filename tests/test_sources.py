"""Discovery of region files in a nested tree with decoys."""

import pytest

from survkit import schema as S
from survkit.sources import files as FI

PIPES = "IDT;DDP;DIAMETRE;MATERIAU;MATAGE\n"
EVENTS = "IDTC;DDCC\n"


def tree(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_nested_tree_with_decoys(spark, tmp_path):
    root = tmp_path / "data_clean"  # the root's own name holds the tag: it doesn't count
    tree(root, {
        "2019/towns_clean/Ville A+B é/Ville_pipes_v1.csv": PIPES + "1;1990-05-01 00:00:00;100.5;FONTE;FONTE1990\n2;1991-01-01 00:00:00;;INCONNU;r\n",
        "2019/towns_clean/Ville A+B é/Ville_events_v1.csv": EVENTS + "1;2001-02-03 10:00:00\n",
        "2019/towns_clean/Ville A+B é/Ville_events_v2.csv": EVENTS + "2;2002-02-03 10:00:00\n",
        "2019/towns_clean/Ville A+B é/notes.txt": "nothing to read",
        "2019/towns_clean/deep/er/Bourg/events.csv": EVENTS + "7;2003-01-01 00:00:00\n",
        "2019/towns_clean/deep/er/Bourg/pipes.csv": PIPES + "7;1980-01-01 00:00:00;80;PVC;PVC1980\n",
        "2019/towns_raw/Ville A+B é/Ville_pipes.csv": PIPES + "9;1990-05-01 00:00:00;1;X;Y\n",
        "2019/towns_raw/Ville A+B é/Ville_events.csv": EVENTS + "9;2001-02-03 10:00:00\n",
        "2020/towns_clean/Bourg/events.csv": EVENTS + "8;2004-01-01 00:00:00\n",
        "2020/towns_clean/Bourg/pipes.csv": PIPES + "8;1981-01-01 00:00:00;81;PVC;PVC1980\n",
        "readme_events.csv": "not in a tagged folder",
    })
    assets, failures = FI.read_region_files(spark, str(root), "_clean", first_only=True)
    a = sorted((r[S.REGION], r[S.ASSET_ID], r[S.SIZE]) for r in assets.collect())
    # the folder later in path order stands for a region that occurs twice
    assert a == [("Bourg", 8, 81.0), ("Ville A+B é", 1, 100.5), ("Ville A+B é", 2, None)]
    assert sorted((r[S.REGION], r[S.ASSET_ID]) for r in failures.collect()) == [("Bourg", 8), ("Ville A+B é", 1)]
    _, parts = FI.read_region_files(spark, str(root), "_clean")
    assert sorted((r[S.REGION], r[S.ASSET_ID]) for r in parts.collect()) == [("Bourg", 8), ("Ville A+B é", 1), ("Ville A+B é", 2)]
    assert FI.discover(spark, str(root), "no such tag").count() == 0
    none, _ = FI.read_region_files(spark, str(root), "no such tag")
    assert none.collect() == []


def test_broken_trees_are_errors(spark, tmp_path):
    tree(tmp_path / "x", {"t_clean/A/pipes.csv": PIPES})
    with pytest.raises(ValueError, match="A has no file"):
        FI.discover(spark, str(tmp_path / "x"), "_clean")
    tree(tmp_path / "y", {"t_clean/A/pipes.csv": "DDP;IDT;DIAMETRE;MATERIAU;MATAGE\n2;1990-01-01 00:00:00;1;A;B\n", "t_clean/A/events.csv": EVENTS})
    assets, _ = FI.read_region_files(spark, str(tmp_path / "y"), "_clean")
    with pytest.raises(Exception, match="(?i)header"):
        assets.collect()


def test_many_small_files_are_one_micro_batch(spark, tmp_path):
    """Each batch joins all assets, so their number must not follow the number of files."""
    from survkit.streaming import incremental as ST

    for k in range(150):
        folder = tmp_path / "in" / f"region=R{k % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"events-{k}.csv").write_text(f"IDTC;DDCC\n{k % 5};2001-03-0{1 + k % 9} 00:00:00\n")
    assets = spark.createDataFrame([(f"R{r}", a) for r in range(3) for a in range(4)], "region string, asset_id bigint")
    counts = ST.counts_by_region_year(ST.failure_stream(spark, str(tmp_path / "in")), assets)
    ST.run_to_table(counts, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(f"R{r}", 2001, 40) for r in range(3)}
    assert len([f for f in (tmp_path / "ckpt" / "commits").iterdir() if f.name.isdigit()]) == 1
