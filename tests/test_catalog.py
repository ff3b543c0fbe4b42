import io
import os

import pytest
from pyspark.sql import functions as F

from shelfmark.__main__ import main
from shelfmark.functions import text as T
from shelfmark.operators import catalog as C
from shelfmark.operators import changes as D
from shelfmark.operators import rules as X
from shelfmark.operators import search as S
from shelfmark.operators import settings as Y
from shelfmark.plans.compiler import compile_query
from shelfmark.sources import filelist, files, mounts, sinks
from shelfmark.streaming import live

SMALL = [
    ("/data", "folder", 0, None), ("/data/books", "folder", 0, None), ("/data/books/Übung.epub", "file", 2048, 1500000000),
    ("/data/books/atlas.epub", "file", 640, 1620000000), ("/data/books/maps", "folder", 0, None),
    ("/data/books/maps/atlas.epub", "file", 12, 1690000000), ("/data/books/void", "folder", 0, None), ("/data/music", "folder", 0, None),
    ("/data/music/Señal.ogg", "file", 77000, None), ("/data/music/field-notes.md", "file", 31, None), ("/data/notes.md", "file", 4, None),
]
NATURAL = ["003", "3", "B", "b", "banana", "elan", "Étude", "log-2020-2-3.log", "log-2020-02-20.log", "part 5", "part1b", "part04", "part4", "r2.8", "r2.12", "SCAN_2.png", "scan_3.png", "SCAN_20.png", "Yak"]


def made(spark, rows, modified=1700000000):
    raw = spark.createDataFrame([(p.encode() if isinstance(p, str) else p, k, s, modified, c) for p, k, s, c in rows], C.RAW)
    return C.build(raw)


@pytest.fixture(scope="module")
def small(spark):
    return made(spark, SMALL).cache()


def names(rows):
    return [r[0] for r in rows.select("name_text").collect()]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("ubung", {"Übung.epub"}), ("ÜBUNG", {"Übung.epub"}), ("path:music senal", {"Señal.ogg"}), ("case:ubung", set()), ("empty:", {"void"}),
        ("child:atlas.epub", {"books", "maps"}), ("child:MAPS", {"books"}), ("ww:notes", {"field-notes.md", "notes.md"}), ("ww:note", set()),
        ("dupe:", {"atlas.epub"}), ("folder: size:>=2700", {"data", "music", "books"}), ("dc:<2022-01-01", {"Übung.epub", "atlas.epub"}),
        ("?eñal.ogg", {"Señal.ogg"}), ("?ñal.ogg", set()), ("!dupe: ext:epub", {"Übung.epub"}), ("<ubung | music> !ext:epub", {"music"}),
        ("!ext:epub !folder:", {"Señal.ogg", "field-notes.md", "notes.md"}), ("!dc:<2022-01-01 file: ext:epub;ogg", {"atlas.epub", "Señal.ogg"}), ("!parent:/ folder: !size:>100", {"maps", "void"}),
    ],
)
def test_queries(small, query, want):
    assert set(names(compile_query(query, small))) == want


def test_sizes(small):
    got = {r.path_text: (r["size"], r["items"]) for r in small.where("kind = 'folder'").collect()}
    assert got["/data/books"] == (2700, 5) and got["/data/books/void"] == (0, 0) and got["/data"] == (79735, 10)


@pytest.mark.parametrize(("query", "column"), [("size:>1kb", "size"), ("dm:>2020", "modified"), ("dc:<2020", "created"), ("parent:/data", "dir"), ("ext:epub size:>1", "fext"), ("ext:epub", "kind"), ("size:>1 | ext:md", "size")])
def test_filters_reach_the_scan(spark, small, tmp_path, query, column):
    """Predicates of a row are pushed to the Parquet scan."""
    import re

    path = str(tmp_path / "catalog")
    small.write.parquet(path)
    plan = compile_query(query, spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PushedFilters: \[[^]]*\b{column}\b", plan), plan


def test_orders(spark, small):
    rows = compile_query("parent:/data/books/", small)
    assert names(S.page(rows, "name").orderBy("rank")) == ["atlas.epub", "maps", "Übung.epub", "void"]
    assert names(S.page(rows, "name", True, 2, 1).orderBy("rank")) == ["Übung.epub", "maps"]
    c = made(spark, [(f"/d/{n}", "file", 1, None) for n in NATURAL])
    assert names(S.page(c, "name").orderBy("rank")) == NATURAL
    c = made(spark, [(p, "folder", 0, None) for p in ("/k", "/k/l", "/k/l/m", "/k l", "/k-m", "/l")])
    assert [r.path_text for r in S.page(c, "path").orderBy("rank").collect()] == ["/k", "/k/l", "/k/l/m", "/k l", "/k-m", "/l"]


def test_types(spark):
    c = made(spark, [("/d", "folder", 0, None), ("/d/photos", "folder", 0, None), *[(f"/d/{n}", "file", 1, None) for n in ("b.SQL", "a.txt", "z.sql", "photos/x.JPG", ".hidden", "notes.md")]])
    assert names(S.page(c, "type").orderBy("rank")) == ["d", "photos", ".hidden", "x.JPG", "notes.md", "b.SQL", "z.sql", "a.txt"]
    assert set(names(compile_query("pic:", c))) == {"x.JPG"} and set(names(compile_query("ext:hidden", c))) == {".hidden"}


def test_bytes_survive(spark):
    c = made(spark, [(b"/x/a\xffb.txt", "file", 5, None), ("/x", "folder", 0, None)])
    row = compile_query("regex:a.b", c).first()
    assert row.path == b"/x/a\xffb.txt" and "�" in row.path_text and row["name"] == b"a\xffb.txt"


def test_contents_and_duplicates(spark, tmp_path):
    data = {"a/x.bin": b"1" * 100_000, "b/y.bin": b"1" * 100_000, "c/z.bin": b"1" * 99_999 + b"2", "d/x.bin": b"123", "e/n.txt": b"The Quarterly Report", "f/n.txt": b""}
    for name, body in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows, errors = files.scan(spark, [str(tmp_path)])
    assert errors.count() == 0
    c = C.build(rows)
    read = files.contents(c)
    find = lambda q: {r.path_text[len(str(tmp_path)) + 1 :] for r in compile_query(q, c, read).collect()}
    assert find("dupe:content") == {"a/x.bin", "b/y.bin"}
    assert find("dupe:size") == {"a/x.bin", "b/y.bin", "c/z.bin"}
    assert find(f'dupe:size !"{tmp_path}/b/"') == {"a/x.bin", "c/z.bin"}
    assert find("content:quarterly") == {"e/n.txt"} and find("case:content:quarterly") == set()


DIFF_OLD = [("/r", "folder", 0), ("/r/a.txt", "file", 1), ("/r/b.txt", "file", 2), ("/r/photos", "folder", 0), ("/r/photos/1.jpg", "file", 10), ("/r/photos/2.jpg", "file", 20), ("/r/report.odt", "file", 5), ("/r/x", "folder", 0), ("/r/x/keep.txt", "file", 3)]
DIFF_NEW = [("/r", "folder", 0), ("/r/a.txt", "file", 9), ("/r/archive", "folder", 0), ("/r/archive/photos", "folder", 0), ("/r/archive/photos/1.jpg", "file", 10), ("/r/archive/photos/2.jpg", "file", 20), ("/r/c.txt", "file", 7), ("/r/report final.odt", "file", 5), ("/r/x", "folder", 0), ("/r/x/keep.txt", "file", 3)]


def rolled(spark, rows):
    return C.rolled_up(spark.createDataFrame([(p.encode(), k, s, 100, None) for p, k, s in rows], C.RAW))


def test_diff(spark):
    old, new = rolled(spark, DIFF_OLD), rolled(spark, DIFF_NEW)
    got = {(r.action, r.path.decode(), r.to.decode() if r.to else None) for r in D.diff(old, new).collect()}
    assert got == {("modified", "/r/a.txt", None), ("created", "/r/archive", None), ("moved", "/r/photos", "/r/archive/photos"), ("created", "/r/c.txt", None), ("deleted", "/r/b.txt", None), ("moved", "/r/report.odt", "/r/report final.odt")}
    assert D.diff(old, new, spark.createDataFrame([("/r/x",)], "raw string")).count() == 0


def raw_rows(spark, rows):
    return spark.createDataFrame([(p.encode(), k, s, 100, None) for p, k, s in rows], C.RAW)


def paths_of(rows):
    return {r.path.decode() for r in rows.select("path").collect()}


def test_generations_and_stream(spark, tmp_path):
    store = sinks.Generations(spark, f"file://{tmp_path}/store")
    assert store.load().count() == 0 and store.meta()["generation"] == 0
    new = raw_rows(spark, DIFF_NEW).cache()
    keeper = live.Live(store, lambda t: D.covered(raw_rows(spark, DIFF_OLD), t), ["/r"], clock=lambda: 1000)
    assert keeper.update(None) == 1 and paths_of(store.load()) == {p for p, _, _ in DIFF_OLD}
    drop = str(tmp_path / "events")
    os.makedirs(drop)
    spark.createDataFrame([(p.encode(), False) for p, _, _ in DIFF_NEW + DIFF_OLD if p != "/r"], "path binary, overflow boolean").coalesce(1).write.mode("overwrite").parquet(drop)
    events = spark.readStream.schema("path binary, overflow boolean").parquet(drop)
    keeper = live.Live(store, lambda t: D.covered(new, t), ["/r"], clock=lambda: 2000)
    keeper.start(events, f"{tmp_path}/check", {"availableNow": True}).awaitTermination()
    assert paths_of(store.load()) == {p for p, _, _ in DIFF_NEW}
    assert store.meta()["generation"] == 2
    assert {(r.t, r.a) for r in store.history().collect()} == {(2000, x) for x in ("modified", "created", "deleted", "moved")}
    before = store.load().count()
    keeper.apply(spark.createDataFrame([(b"/r", True)], "path binary, overflow boolean"), 0)  # a batch that ran before
    assert store.meta()["generation"] == 2 and store.load().count() == before
    keeper.apply(spark.createDataFrame([(b"/r", True)], "path binary, overflow boolean"), 9)  # events were lost: a full scan
    assert store.meta()["generation"] == 3 and store.meta()["batch"] == 9
    store.compact_history(2000 + 86_400)
    assert store.history().count() == 6 and store.load().count() == before
    store.compact_history(2000 + 31 * 86_400)
    assert store.history().count() == 0 and store.load().count() == before
    assert keeper.wait(2) >= 3 and keeper.wait(99, 0.1) < 99
    store.vacuum()
    assert store.load().count() == before and len(store.folder.files("data")) == 1


def test_update_touches_its_buckets_alone(spark, tmp_path):
    """Rows of other buckets keep their files, and the catalog is what a fresh scan gives."""
    rows = [("/r", "folder", 0), *[x for i in range(12) for x in ((f"/r/a{i}", "folder", 0), (f"/r/a{i}/b", "folder", 0), (f"/r/a{i}/b/f", "file", i), (f"/r/a{i}/b/c/d", "file", 9))]]
    disk = {"rows": rows}
    store = sinks.Generations(spark, f"file://{tmp_path}/s", depth=3, buckets=16)
    keeper = live.Live(store, lambda t: D.covered(raw_rows(spark, disk["rows"]), t), ["/r"])
    keeper.update(None)
    first = store.meta()["parts"]
    disk["rows"] = [(p, k, s + 5 if p == "/r/a3/b/f" else s) for p, k, s in rows if not p.startswith("/r/a4/b/c")] + [("/r/a4/b/new", "file", 1)]
    keeper.update(spark.createDataFrame([("/r/a3/b/f",), ("/r/a4/b",)], "raw string"))
    later = store.meta()["parts"]
    assert 1 <= sum(later[b] != first.get(b) for b in later) <= 2 and len(first) > 4
    assert {(r.path.decode(), r["size"]) for r in store.load().collect()} == {(p, s) for p, _, s in disk["rows"]}
    disk["rows"] = [x for x in rows if not x[0].startswith("/r/a5")]
    keeper.update(spark.createDataFrame([("/r/a5",)], "raw string"))  # above the buckets' depth: all of them
    assert not {p for p in paths_of(store.load()) if p.startswith("/r/a5")}


def test_crashes(spark, tmp_path):
    """Between any two steps of an update the store is what it was before; damage is seen, set aside and scanned anew."""
    store = sinks.Generations(spark, f"file://{tmp_path}/s")
    keeper = live.Live(store, lambda t: D.covered(raw_rows(spark, DIFF_OLD), t), ["/r"])
    keeper.update(None)
    keeper.scan = lambda t: D.covered(raw_rows(spark, DIFF_NEW), t)
    for step in ("_written", "_point"):
        def broken(*a, **k):
            raise RuntimeError("power is gone")

        setattr(store, step, broken)
        with pytest.raises(RuntimeError):
            keeper.store.publish(raw_rows(spark, DIFF_NEW))
        delattr(store, step)
        assert store.meta()["generation"] == 1 and paths_of(store.load()) == {p for p, _, _ in DIFF_OLD}
        store.check()
    assert not store.folder.create("pointer-1.json", b"{}")  # a generation is never published twice
    assert keeper.update(None) == 2 and paths_of(store.load()) == {p for p, _, _ in DIFF_NEW}
    part = next(iter(store.meta()["parts"].values()))
    os.remove(tmp_path / "s" / part[0] / next(iter(part[1])))
    with pytest.raises(sinks.DamagedError):
        store.check()
    keeper.update(spark.createDataFrame([("/r/x",)], "raw string"))
    store.check()
    assert paths_of(store.load()) == {p for p, _, _ in DIFF_NEW}


def test_watched_roots(spark, tmp_path):
    events = spark.createDataFrame([(p.encode(), False) for p in ("/r/a", "/r/no/x", "/r/no/in/y", "/f/a", "/f/a/b", "/q")], "path binary, overflow boolean")
    rules = X.Rules(roots=("/r", "/f"), excluded_folders=("/r/no",), included_folders=("/r/no/in",))
    assert paths_of(live.accepted(events, ["/r", "/f"], ("/f",), rules)) == {"/r/a", "/r/no/in/y", "/f/a"}
    drive = tmp_path / "drive"
    drive.mkdir()
    (drive / "x").write_text("1")
    rows = [(str(drive), "folder", 0), (f"{drive}/x", "file", 1), ("/r", "folder", 0), ("/r/a", "file", 1)]
    disk = {"rows": rows}
    keeper = live.Live(sinks.Generations(spark, f"file://{tmp_path}/s"), lambda t: D.covered(raw_rows(spark, disk["rows"]), t), ["/r", str(drive)], keep_offline=(str(drive),))
    keeper.update(None)
    (drive / "x").unlink()
    disk["rows"] = [("/r", "folder", 0), (str(drive), "folder", 0)]
    keeper.rescan()
    assert live.offline([str(drive), "/r/none"]) == [str(drive), "/r/none"]
    assert paths_of(keeper.store.load()) == {"/r", str(drive), f"{drive}/x"}
    keeper.rules = X.Rules(roots=("/r", str(drive)), excluded_files=("b",))
    disk["rows"] += [("/r/b", "file", 1), ("/r/c", "file", 1)]
    keeper.rescan("/r")
    assert {"/r/c"} == {p for p in paths_of(keeper.store.load()) if p.startswith("/r/")}
    errors = spark.createDataFrame([(b"/r/%d" % i, "denied") for i in range(60)], "path binary, error string")
    got = keeper.status(errors)
    assert got["error_count"] == 60 and len(got["errors"]) == 50 and got["offline"] == [str(drive)] and got["paused"]


def test_quick_start(spark):
    """Only changed folders are read again; the rest is what was saved."""
    row = lambda p, k, s, m: (p.encode(), k, s, m, None)
    old = spark.createDataFrame([row("/r", "folder", 0, 10), row("/r/a", "folder", 0, 10), row("/r/a/1", "file", 1, 10), row("/r/b", "folder", 0, 10), row("/r/b/2", "file", 2, 10), row("/r/gone", "folder", 0, 10), row("/r/gone/3", "file", 3, 10)], C.RAW)
    disk = [row("/r", "folder", 0, 60), row("/r/a", "folder", 0, 10), row("/r/a/1", "file", 99, 70), row("/r/b", "folder", 0, 55), row("/r/b/4", "file", 4, 55)]
    now = spark.createDataFrame(disk, C.RAW)
    direct = lambda t: now.join(t.select(F.col("raw").alias("_in")), F.regexp_extract(F.col("path").cast("string"), "^(.*)/", 1) == F.col("_in"), "left_semi")
    got = {(r.path.decode(), r["size"]) for r in live.caught_up(old, now.where("kind = 'folder'"), 50, direct).collect()}
    assert got == {("/r", 0), ("/r/a", 0), ("/r/a/1", 1), ("/r/b", 0), ("/r/b/4", 4)}


def test_moves_into_each_other(spark):
    """A folder that lies inside the deleted one is not its new place; the next one is taken."""
    keep = lambda rows: spark.createDataFrame([(p.encode(), "folder", 0, 100, None) for p in rows], C.RAW)
    got = {(r.action, r.path.decode(), r.to.decode() if r.to else None) for r in D.diff(keep(["/r/x"]), keep(["/r/x2/x", "/r/z/x"])).collect()}
    assert ("moved", "/r/x", "/r/x2/x") in got
    changes = spark.createDataFrame([("deleted", "folder", b"/r/x", 0, 1, None), ("created", "folder", b"/r/x/q/x", 0, 1, None), ("created", "folder", b"/r/y/x", 0, 1, None)], "action string, kind string, path binary, size long, modified long, created long")
    assert [(r.path, r.to) for r in D.paired(changes).where("action = 'moved'").collect()] == [(b"/r/x", b"/r/y/x")]


def test_path_export(spark, tmp_path):
    c = made(spark, [(b"/x/a\xffb", "file", 5, None), ("/x/c", "file", 5, None)])
    sinks.write_paths(c.coalesce(1), f"{tmp_path}/out", "\0")
    assert b"".join(f.read_bytes() for f in (tmp_path / "out").glob("part-*")) == b"/x/a\xffb\0/x/c\0"


def test_big_duplicates(spark, tmp_path):
    """dupe:content reads whole files of any size; content: stops at its limit."""
    for name, tail in (("p", b"1"), ("q", b"1"), ("r", b"2")):
        (tmp_path / name).write_bytes(bytes(17 << 20) + tail)
    c = C.build(files.scan(spark, [str(tmp_path)])[0])
    assert set(names(compile_query("dupe:content", c, files.Contents()))) == {"p", "q"}
    assert names(compile_query("content:1", c, files.Contents())) == []


def test_mounts(spark):
    table = "36 35 98:0 / /media/mi\\040x rw shared:1 - ext4 /dev/sdb rw\n1 0 0:1 / / rw - ext4 a rw\n2 1 0:2 / /net rw - fuse.sshfs h: rw\n3 1 0:2 / /media/n rw - nfs4 h: rw\nnonsense"
    m = mounts.parsed(spark, table)
    paths = spark.createDataFrame([(p.encode(),) for p in ("/a/b", "/net/x", "/network", "/media/mi x/f")], "path binary")
    assert {r.path: (r.point, r.type) for r in mounts.mounted(paths, m).collect()} == {b"/a/b": (b"/", "ext4"), b"/net/x": (b"/net", "fuse.sshfs"), b"/network": (b"/", "ext4"), b"/media/mi x/f": (b"/media/mi x", "ext4")}
    assert [bytes(r.point) for r in mounts.removable(m, "me").collect()] == [b"/media/mi x"]
    assert mounts.current(spark).count() > 0


def test_settings(spark, tmp_path):
    day = Y.Schedule(daily=(3, 30))
    assert day.next_after(0) == 12_600 and day.next_after(12_600) == 99_000 and Y.Schedule(60, None).next_after(5) == 65 and Y.Schedule(None, None).next_after(5) is None
    store = Y.SettingsStore(spark, f"file://{tmp_path}")
    s = Y.Settings(roots=(Y.Root("/a"), Y.Root("/b", schedule=day)), rules=X.Rules(roots=(), excluded_types=("tmp",)), filters={"big": "size:>1gb"})
    assert store.load() == Y.Settings() and store.save(0, s).revision == 1
    assert store.load() == Y.replace(s, revision=1)
    with pytest.raises(ValueError, match="elsewhere"):
        store.save(0, s)
    for bad in (Y.replace(s, roots=(Y.Root("/a"), Y.Root("/a/b"))), Y.replace(s, debounce_ms=1), Y.replace(s, filters={"": "x"}), Y.replace(s, filters={"x": "size:>"}), Y.replace(s, roots=(Y.Root("/proc/x"),)), Y.replace(s, roots=(Y.Root("a/../b"),)), Y.replace(s, filters={str(i): "x" for i in range(201)})):
        with pytest.raises(ValueError):
            bad.checked()
    assert s.fingerprint() == Y.replace(s, roots=(Y.Root("/a"), Y.Root("/b"))).fingerprint() != Y.replace(s, roots=(Y.Root("/a"),)).fingerprint()
    assert Y.deadlines(s, {"/a": 0, "/b": 99_999}, 100_000) == {"/a": 100_600, "/b": 185_400}
    grown, new = Y.with_drives(Y.replace(s, removable_drives=True), ["/media/u", "/a/x"])
    assert new == ["/media/u"] and grown.roots[-1].keep_offline and Y.with_drives(s, ["/media/u"])[1] == []
    assert [X.file_type(t) for t in ("*.TAR.gz", " tmp ", "a..b", "", "a b", "x.")] == ["tar.gz", "tmp", None, None, None, None]
    assert X.excluding(X.Rules(excluded_folders=("/a/b",)), ["/a/", "/c"]).excluded_folders == ("/a", "/c")
    assert X.normalized_roots([f"{tmp_path}/", str(tmp_path)]) == [os.path.realpath(tmp_path)]
    where = spark.createDataFrame([("/home/me/x",), ("/home/me2/y/x",), ("/z",)], "p string").select(T.location(F.col("p"), "/home/me"))
    assert [r[0] for r in where.collect()] == ["~", "/home/me2/y", "/"]


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.md", "sub"):
        (tmp_path / "in" / name).write_text(name)

    def said(*words):
        out = io.BytesIO()
        return main([f"file://{tmp_path}/store", *words], spark, out), out.getvalue().decode()

    assert said("index", str(tmp_path / "in")) == (0, "4 entries\n")
    root = os.path.realpath(tmp_path / "in")
    assert said("search", "ext:txt;md", "--sort", "name", "--descending") == (0, f"{root}/b.md\n{root}/a.txt\n")
    assert said("search", "ext:md", "--null") == (0, f"{root}/b.md\0")
    assert '"size":4' in said("search", "ext:md", "--json")[1] and said("search", "ext:md", "--csv")[1].splitlines()[1].startswith("b.md,")
    assert said("search", "size:>x")[0] == 2 and said("search", "content:b.m") == (0, f"{root}/b.md\n")
    (tmp_path / "in" / "c.txt").write_text("new")
    assert said("rescan") == (0, "generation 2\n") and "created" in said("changes")[1] and "c.txt" in said("changes", "C.TXT")[1]
    assert "entries: 5" in said("status")[1] and root in said("config")[1]
    (tmp_path / "s.json").write_text('{"roots": [{"path": "/nowhere", "keep_offline": true}]}')
    assert said("config", str(tmp_path / "s.json"))[0] == 0 and said("rescan", root)[0] == 2


def test_rules(spark):
    rows = spark.createDataFrame([(p, k) for p, k in [("/r", "folder"), ("/r/.git", "folder"), ("/r/.git/x", "file"), ("/r/a.tmp", "file"), ("/r/.tmp", "file"), ("/r/b.TAR.GZ", "file"), ("/r/no/in/f", "file"), ("/r/no/g", "file"), ("/r/.snapshots/1", "folder"), ("/r/log/a.log", "file")]], "path string, kind string")
    keep = lambda **k: {r.path for r in X.kept(rows, X.Rules(roots=("/r",), **k)).collect()}
    assert "/r/.tmp" in keep(excluded_types=("tmp", "tar.gz")) and not {"/r/a.tmp", "/r/b.TAR.GZ"} & keep(excluded_types=("tmp", "tar.gz"))
    assert {"/r/no/in/f"} == {p for p in keep(excluded_folders=("/r/no",), included_folders=("/r/no/in",)) if p.startswith("/r/no")}
    assert not {"/r/.git", "/r/.git/x"} & keep(exclude_hidden=True)
    assert "/r/.snapshots/1" not in keep() and "/r/.snapshots/1" in keep(exclude_snapshots=False)
    assert "/r/log/a.log" not in keep(excluded_files=("log/*.log",))
    assert X.added_paths(X.Rules(("/a",)), X.Rules(("/a", "/b"))) == ["/b"] and X.added_paths(X.Rules(("/a", "/b")), X.Rules(("/a",))) is None


def test_file_lists(spark, tmp_path):
    (tmp_path / "l.efu").write_text('\ufeffFilename,Size,Date Modified,Date Created,Attributes\r\n"C:\\d\\a ""x"".txt",12,133000000000000000,,32\r\n"C:\\d\\sub\\",,2024-01-02,,16\r\n')
    got = filelist.read(spark, str(tmp_path / "l.efu"))
    rows = got.collect()
    assert [(r.path, r.folder, r["size"]) for r in rows] == [('C:\\d\\a "x".txt', False, 12), ("C:\\d\\sub", True, 0)]
    assert [r.modified for r in rows] == [1655526400, 1704153600]
    assert {r.path.decode() for r in filelist.as_root(got, "c:/D", "/m").collect()} == {"/m", '/m/a "x".txt', "/m/sub"}
    assert filelist.common_folder(["C:\\a\\b\\c", "c:\\A\\b2\\d"]) == "C:/a"


def test_small_tools(spark):
    assert S.completions("si", ["size:>1 x"]) == ["size:>1 x", "size:"]
    assert D.since_seconds("2w") == 1_209_600
    assert spark.range(1).select(F.lit(1)).count() == 1
