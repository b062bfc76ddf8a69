"""Zip ingest: containment, prefixes, resumption, repeated names."""

import zipfile

import pytest

from tidemark.sources import folders, zips


@pytest.mark.parametrize(
    ("name", "want"),
    [("Pack/a/b.mp4", ("a/b.mp4", True)), ("x.txt", ("x.txt", True)), ("a/../b", ("b", True)), ("../x", ("../x", False)), ("a/../../x", ("../x", False)), ("/etc/passwd", ("/etc/passwd", False)),
     ("Pack/../x", ("../x", False)), ("..\\x", ("../x", False)), ("C:/x", ("C:/x", False)), ("Pack//x", ("/x", False)), ("..", ("..", False)), ("..x/y", ("..x/y", True))],
)
def test_paths_stay_inside(name, want):
    assert zips.inside(name, "Pack/") == want


def archive(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in files:
            z.writestr(name, content)
    return str(path)


def outcomes(df):
    return sorted(((r["zip"][-5:], r["name"], r["outcome"]) for r in df.collect()), key=str)


def test_ingest_is_like_one_archive_after_the_other(spark, tmp_path):
    a = archive(tmp_path / "a.zip", [("P/x.txt", "one"), ("P/d/y.txt", "deep"), ("P/", ""), ("../evil", "no"), ("empty", "")])
    b = archive(tmp_path / "b.zip", [("P/x.txt", "two"), ("P/d/y.txt", "other"), ("z", "zz" * 3_000_000)])
    (tmp_path / "c.zip").write_bytes(b"no archive")
    out = tmp_path / "out"
    all_ = [a, b, str(tmp_path / "c.zip")]
    got = outcomes(zips.ingest(spark, all_, str(out), "P/"))
    assert got == sorted([("a.zip", "P/x.txt", "written"), ("a.zip", "P/d/y.txt", "replaced"), ("a.zip", "../evil", "outside"), ("a.zip", "empty", "written"), ("b.zip", "P/x.txt", "present"), ("b.zip", "P/d/y.txt", "written"), ("b.zip", "z", "written"), ("c.zip", None, "unreadable")], key=str)
    assert {p.relative_to(out).as_posix(): p.read_text() for p in out.rglob("*") if p.is_file()} == {"x.txt": "one", "d/y.txt": "other", "empty": "", "z": "zz" * 3_000_000}
    assert not (tmp_path / "evil").exists()
    # what was cut short, or is of another size, is written again, the rest is left alone
    (out / "x.txt").write_text("o")
    before = (out / "z").stat().st_mtime_ns
    again = {(z, n): o for z, n, o in ((r["zip"][-5:], r["name"], r["outcome"]) for r in zips.ingest(spark, all_, str(out), "P/").collect())}
    assert again[("a.zip", "P/x.txt")] == "written" and again[("b.zip", "z")] == "present" and (out / "z").stat().st_mtime_ns == before
    assert (out / "x.txt").read_text() == "one"
    forced = {r["outcome"] for r in zips.ingest(spark, [b], str(out), "P/", force=True).collect()}
    assert forced == {"written"} and (out / "x.txt").read_text() == "two"
    assert zips.ingest(spark, [], str(out)).count() == 0


def test_entries_are_unpacked_by_place_without_the_directory(tmp_path):
    """Entries of every packing, found where their row says; a damaged one is noticed."""
    path, want = tmp_path / "a.zip", {}
    with zipfile.ZipFile(path, "w") as z:
        for i, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)):
            want[f"é{i}"] = f"text {i} " * 5000
            z.writestr(f"é{i}", want[f"é{i}"], method)
    with zipfile.ZipFile(path) as z:
        rows = [(i.filename, i.file_size, i.header_offset, i.compress_size, i.compress_type, i.CRC, i.flag_bits) for i in z.infolist()]
    with folders.store_of(str(path))[0].open_input_file(str(path)) as file:
        assert {r[0]: zips._opened(file, *r).read().decode() for r in reversed(rows)} == want
        with pytest.raises(zipfile.BadZipFile):
            zips._opened(file, *rows[1][:5], rows[1][5] ^ 1, rows[1][6]).read()
        with pytest.raises(zipfile.BadZipFile):
            zips._opened(file, *rows[1][:2], 7, *rows[1][3:])


def test_folders_are_listed_and_read_in_tasks(spark, tmp_path):
    out = tmp_path / "out"
    assert folders.below(spark, str(out)).count() == 0
    want = {}
    for i in range(300):
        at = out / str(i % 5) / "deep" / f"{i}.txt"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(want.setdefault(f"{i % 5}/deep/{i}.txt", f"é{i}" * (i % 3)))
    found = folders.below(spark, str(out))
    assert {r["rel"]: r["size"] for r in found.collect()} == {k: len(v.encode()) for k, v in want.items()}
    assert {r["rel"]: bytes(r["content"]).decode() for r in folders.contents(found, str(out)).collect()} == want
