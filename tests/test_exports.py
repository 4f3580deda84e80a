"""Exports as they come: odd headers, blank first lines, files of one name, hidden files."""

import csv
import io
import pathlib
import random

import pytest

from opsframe.sources import exports


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        for name, text in files.items():
            path = tmp_path / name.replace("__", "/").replace("_csv", ".csv")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text, encoding="utf-8")
        return str(tmp_path)

    return write


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_quoted_repeated_and_empty_names(spark, folder):
    path = folder(a_csv='"amount,net",name\n1,x\n', b_csv="name,amount,amount\ny,2,3\n", c_csv="name,,amount\nz,4,5\n")
    df = exports.read_exports(spark, path)
    assert set(df.columns) == {"amount,net", "name", "amount", "amount_2", "_c1", "__source__", "__row__"}
    got = {r["name"]: r for r in df.collect()}
    assert (got["x"]["amount,net"], got["y"]["amount"], got["y"]["amount_2"], got["z"]["_c1"], got["z"]["amount"]) == ("1", "2", "3", "4", "5")


@pytest.mark.parametrize("split", [4, 1 << 20])
def test_blank_first_line(spark, folder, split):
    df = exports.read_exports(spark, folder(a_csv="\nname,amount\nx,1\ny,2\n"), split=split)
    assert df.columns == ["name", "amount", "__source__", "__row__"]
    assert rows(df, "name", "amount") == [("x", "1"), ("y", "2")]


def test_gate_tells_folders_apart(spark, folder):
    path = folder(x__s_csv="name,amount\na,1\n", y__s_csv="name,amount\nb,none\n", z__t_csv='name;"amount, net"\nb;1\n')
    profile = exports.profile_files(spark, path, recursive=True)
    table = exports.read_exports(spark, path, recursive=True, profile=profile, with_path=True)
    got = rows(exports.rejected_files(profile, table, "amount"), "file", "reason")
    assert [g[0] for g in got] == ["s.csv", "t.csv"] and "amount, net" in got[1][1]


def test_underscored_files_are_read_and_hidden_ones_named(spark, folder):
    path = folder(a_csv="name\nx\n", sub__deep___e_csv="name\ny\n", sub___tmp__z_csv="name\nno\n")
    root = pathlib.Path(path)
    for name in ("_draft.csv", ".x.csv", "sub/deep/.y.CSV", "sub/deep/notes.txt"):
        (root / name).write_text("name\nz\n")
    df = exports.read_exports(spark, path, recursive=True)
    assert rows(df, "name", "__source__") == [("x", "a.csv"), ("y", "_e.csv"), ("z", "_draft.csv")]
    assert rows(exports.read_exports(spark, path), "name") == [("x",), ("z",)]
    assert rows(exports.hidden_files(spark, path), "file") == [(".x.csv",), ("sub/_tmp/z.csv",), ("sub/deep/.y.CSV",)]


def awkward(rng, n):
    """Cells with quotes, line breaks of both kinds, separators, blanks and letters of several bytes."""
    piece = ["a", "bc", '"', "\n", "\r\n", ",", "客户", " ", "", "12", ";"]
    return [["".join(rng.choice(piece) for _ in range(rng.randrange(6))) for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize("charset, split", [("utf-8", 7), ("utf-8-sig", 64), ("gb18030", 50), ("utf-8", 1000)])
def test_quoted_line_breaks_at_split_borders(spark, tmp_path, charset, split):
    rng = random.Random(split)
    table = [["客户", "b", "c"], ["客户, 一", "x;y", "2,3"]] + awkward(rng, 120 if split < 60 else 400)
    with open(tmp_path / "a.csv", "w", encoding=charset, newline="") as f:
        writer = csv.writer(f, lineterminator="\r\n" if split % 2 else "\n")
        for i, r in enumerate(table):
            writer.writerow(r)
            if i % 9 == 4:
                f.write("\n")  # blank lines are no rows
    got = exports.read_exports(spark, str(tmp_path), split=split, drop_blank=False, sep=",").collect()
    assert len({r["__row__"] for r in got}) == len(got) == len(table) - 1
    by_row = {r["__row__"]: [r["客户"], r["b"], r["c"]] for r in got}
    assert [by_row[i] for i in range(1, len(table))] == table[1:]


@pytest.mark.parametrize("text", ['id,v\n1,5" pipe\n2,"a\nb"\n3,c\n', "id,v\r1,x\r2,y\r3,z\r", 'id,v\n1, "x"\n2,"y"\n3,"""z"""\n'])
def test_quotes_inside_cells_and_lone_returns(spark, tmp_path, text):
    (tmp_path / "a.csv").write_bytes(text.encode())
    want = list(csv.reader(io.StringIO(text, newline="")))[1:]
    got = {r["__row__"]: [r.id, r.v] for r in exports.read_exports(spark, str(tmp_path), split=5, sep=",").collect()}
    assert [got[i] for i in (1, 2, 3)] == want


def test_long_line_and_long_cell(spark, tmp_path):
    cell = "x" * 3_000_000 + '\n"' + "y" * 2_000_000
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f).writerows([["id", "v"], ["1", cell], ["2", "end"]])
    got = {r.id: (r.v, r["__row__"]) for r in exports.read_exports(spark, str(tmp_path), split=1_500_000).collect()}
    assert got == {"1": (cell, 1), "2": ("end", 2)}


def test_delimiter_from_several_lines(spark, folder):
    path = folder(a_csv="x,y,z;c;d\n1;2;3\n4;5;6\n7;8;9\n", b_csv="only\n")
    found = {r.file.rsplit("/", 1)[-1]: r.sep for r in exports.profile_files(spark, path).collect()}
    assert found == {"a.csv": ";", "b.csv": ","}


def test_empty_files_and_folders(spark, folder):
    path = folder(a_csv="", b_csv="\n \n")
    assert exports.read_exports(spark, path).count() == 0
    assert rows(exports.rejected_files(exports.profile_files(spark, path), exports.read_exports(spark, path), "v"), "file", "reason") == [
        ("a.csv", "空文件"), ("b.csv", "空文件")]
