import io
import zipfile

import pytest

from stratalog.sources import archives, codecs, packages, sections

NAMES = ["None", "Core", "Package", "Class", "Engine", "Actor", "Map1", "Obj"]
IMPORTS = [{"class_package": "Core", "class_name": "Package", "outer_index": 0, "object_name": "Engine"}, {"class_package": "Core", "class_name": "Class", "outer_index": -1, "object_name": "Actor"}]
EXPORTS = [{"class": -2, "outer_index": 0, "object_name": "Map1", "flags": 1, "serial_size": 77, "serial_offset": 900}, {"class": 0, "super": -2, "outer_index": 1, "object_name": "Obj", "flags": 4, "serial_size": 0}]
MEMBERS = {"System/A.u": b"abc" * 5000, "Maps/B.unr": b"", "x.txt": b"hello"}


@pytest.mark.parametrize("version", [61, 64, 68, 99, 100, 199, 334, 512, 864, -352, -504, -517])
def test_package_tables(version):
    data = packages.write_package(version, NAMES, IMPORTS, EXPORTS)
    for data in [data] + ([packages.write_package(version, NAMES, IMPORTS, EXPORTS, packed=True)] if version >= 334 else []):
        p = packages.read_package(data)
        assert p["status"] == "ok" and [n for n, _ in p["names"]] == NAMES
        assert [(r["object_name"], r["class_name"], r["class_package"], r["outer_index"]) for r in p["imports"]] == [("Engine", "Package", "Core", 0), ("Actor", "Class", "Core", -1)]
        assert [(r["object_name"], r["class_name"], r["class_package"], r["flags"], r["serial_size"]) for r in p["exports"]] == [("Map1", "Actor", "Engine", 1, 77), ("Obj", "Class", "Core", 4, 0)]
        for cut in range(0, len(data), 11):  # nothing is guessed
            assert packages.read_package(data[:cut])["status"] != "ok"


def test_package_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.u").write_bytes(packages.write_package(69, NAMES, IMPORTS, EXPORTS))
    (tmp_path / "sub" / "b.u").write_bytes(b"junk and more")
    (tmp_path / "sub" / "short.u").write_bytes(b"\xc1")
    rows = packages.read_packages(spark, str(tmp_path), "*.u").collect()
    assert sorted({(r.path.split("/")[-1], r.status) for r in rows}) == [("a.u", "ok"), ("b.u", "bad_tag"), ("short.u", "truncated")]
    assert sum(r.section == "names" for r in rows) == len(NAMES)


def _zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in MEMBERS.items():
            z.writestr(k, v)
        z.writestr("../out", "x")
    return out.getvalue()


def test_archives():
    assert archives.crc_forward(b"123456789") == 0xFC891918
    made = [("mod", archives.write_mod(MEMBERS))] + [("pak", archives.write_pak(MEMBERS, v, p)) for v in range(3, 10) for p in (False, True)] + [("zip", _zip())]
    for kind, data in made:
        assert archives.kind_of("", data) == kind
        rows = archives.LISTERS[kind](data)
        assert {r["entry"]: archives.entry_bytes(kind, data, r) for r in rows if r["status"] == "ok"} == MEMBERS
    assert [r["status"] for r in rows if r["entry"] == "../out"] == ["unsafe_path"]
    broken = bytearray(archives.write_mod(MEMBERS))
    broken[3] ^= 1
    with pytest.raises(packages.Broken, match="bad_checksum"):
        archives.list_mod(bytes(broken))


def test_archives_keep_what_fails(spark):
    data = [("m", archives.write_mod(MEMBERS)), ("z", _zip()), ("u", b"?"), ("e", None)]
    files = spark.createDataFrame(data, "path string, content binary")
    assert {(r.path, r.status) for r in archives.archive_entries(files).where("status <> 'ok'").collect()} == {("z", "unsafe_path"), ("u", "unsupported_kind"), ("e", "unsupported_kind")}
    got = archives.archive_members(files).collect()
    assert sorted(r.status for r in got) == ["ok"] * 6 + ["unsafe_path", "unsupported_kind", "unsupported_kind"]
    assert all((r.content is None) == (r.status != "ok") for r in got)


def test_codecs():
    end = b"\x11\0\0"
    assert codecs.lzo1x(bytes([22]) + b"hello" + end, 5) == b"hello"
    assert codecs.lzo1x(bytes([21]) + b"abcd" + bytes([7 << 5 | 3 << 2, 0]) + end, 12) == b"abcd" * 3
    assert codecs.lzo1x(bytes([21]) + b"abcd" + bytes([32 | 4, 3 << 2 | 2, 0]) + b"xy" + end, 12) == b"abcdabcdabxy"
    assert codecs.lzo1x(bytes([21]) + b"abcd" + bytes([32, 1, 0, 0]) + end, 38) == b"abc" + b"d" * 35
    for bad in (b"", b"\x16hel", bytes([21]) + b"abcd" + bytes([64, 255]) + end):
        with pytest.raises(ValueError):
            codecs.lzo1x(bad, 9)
    for data in (b"", b"x", b"ab" * 70_000):
        assert codecs.read_chunked(codecs.write_chunked(data)) == data == codecs.read_tagged(codecs.write_tagged(data))
    with pytest.raises(ValueError, match="unsupported"):
        codecs.decode("oodle", b"x", 1)
    with pytest.raises(ValueError):
        codecs.decode("none", b"xy", 1)


def test_publication_takes_a_file_out_of_other_sections(spark, tmp_path):
    path = str(tmp_path / "s")
    row = lambda game, section, f, tag: (game, section, f, 0, tag)
    publish = lambda rows, n: sections.publish(spark.createDataFrame(rows, sections.SCHEMA), path, str(tmp_path / f"st{n}"))
    publish([row(1, "names", 1, "a"), row(1, "exports", 1, "a"), row(1, "exports", 2, "a"), row(1, "imports", 1, "a")], 1)
    publish([row(1, "names", 1, "b")], 2)
    assert {(r.section, r.file_id, r.payload) for r in sections.read(spark, path).collect()} == {("names", 1, "b"), ("exports", 2, "a")}


def test_sections(spark, tmp_path):
    def rows(files, tag):
        return spark.createDataFrame([(1 + f % 2, "names", f, i, f"{tag}{f}.{i}") for f in files for i in range(5)], sections.SCHEMA)

    path = str(tmp_path / "s")
    sections.publish(rows([1, 2, 3], "a"), path, str(tmp_path / "st1"))
    before = sections.blocks(sections.read(spark, path), 2).collect()
    assert len(before) == 9
    sections.publish(rows([3, 4], "b"), path, str(tmp_path / "st2"))
    sections.publish(rows([3, 4], "b"), path, str(tmp_path / "st3"))  # again: no change
    now = sections.read(spark, path)
    assert {(r.file_id, r.payload[0]) for r in now.collect()} == {(1, "a"), (2, "a"), (3, "b"), (4, "b")} and now.count() == 20
    problems = sections.verify(now, spark.createDataFrame(before), 2)
    assert {(r.file_id, r.problem) for r in problems.collect()} == {(3, "changed"), (4, "unexpected")}
    assert [r["index"] for r in sections.page(now, 2, "names", 1, 2, 2).orderBy("index").collect()] == [2, 3]
    assert sections.at_positions(now, spark.createDataFrame([(1, 0), (4, 4), (9, 9)], "file_id long, index long")).count() == 2
