from pyspark.sql import functions as F

from movara.sources import ingest as I


def write(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))


def test_folder_ingest(spark, tmp_path):
    write(tmp_path, "title_row.csv", 'Relatório de Vendas\nProduto;Descrição;Valor\nCafé;"doce; forte";10,5\nChá;leve;7\n', "latin-1")
    write(tmp_path, "bom.csv", "﻿produto,valor\ncafe,1\ncha,2\n")
    write(tmp_path, "ragged.csv", "produto,valor,status\ncafe,1\ncha,2,ok,x\n")
    write(tmp_path, "no_header.csv", "1,2,3\n4,5,6\n")
    write(tmp_path, "one_column.csv", "valor\n10\n20\n")
    write(tmp_path, "numbers.csv", "10\n20\n30\n")
    write(tmp_path, "pipe.txt", "produto|valor\ncafe|1\ncha|2\n")
    write(tmp_path, "tab.tsv", "produto\tvalor\ncafe\t1\ncha\t2\n")
    write(tmp_path, "empty.csv", "")
    write(tmp_path, "blank.csv", "\n  \n\n")
    report, body = I.ingest(spark, str(tmp_path))
    got = {r.file.rsplit("/", 1)[1]: r for r in report.collect()}
    accepted = {name for name, r in got.items() if r.accepted}
    assert accepted == {"title_row.csv", "bom.csv", "ragged.csv", "one_column.csv", "pipe.txt", "tab.tsv"}
    assert {n: r.reason for n, r in got.items() if not r.accepted} == {
        "no_header.csv": "no_header", "numbers.csv": "no_header", "empty.csv": "empty", "blank.csv": "blank",
    }
    assert got["blank.csv"].blank_rows_dropped == 3 and got["bom.csv"].blank_rows_dropped == 0
    assert got["title_row.csv"].metadata_rows == 1 and got["title_row.csv"].separator == ";"
    assert got["pipe.txt"].separator == "|" and got["tab.tsv"].separator == "\t"
    assert got["ragged.csv"].parsed_columns == 4 and got["ragged.csv"].generic_names == 1
    body = body.cache()
    sold = I.table_of(body, ["Produto", "Descrição", "Valor"])
    assert {tuple(r) for r in sold.collect()} == {("Café", "doce; forte", "10,5"), ("Chá", "leve", "7")}
    typed = I.coerce_types(sold)
    assert dict(typed.dtypes) == {"Produto": "string", "Descrição": "string", "Valor": "double"}
    assert typed.agg(F.sum("Valor")).first()[0] == 17.5
    short = I.table_of(body, ["produto", "valor"])
    assert short.count() == 6 and short.columns == ["produto", "valor"]


def plain_cells(line, separator):
    """Cells read character by character; a quote that never closes is a plain character."""
    cells, at = [], 0
    while True:
        text, i = "", at
        if line[i : i + 1] == '"':
            i += 1
            while i < len(line) and (line[i] != '"' or line[i + 1 : i + 2] == '"'):
                text, i = text + line[i], i + (2 if line[i] == '"' else 1)
            if i < len(line):
                i += 1
            else:
                text, i = "", at
        end = line.find(separator, i)
        end = len(line) if end < 0 else end
        cells.append(text + line[i:end])
        if end == len(line):
            return cells
        at = end + len(separator)


def test_split_cells(spark):
    import itertools
    import random

    draw = random.Random(7)
    lines = ["".join(p) for n in range(5) for p in itertools.product('",a', repeat=n)]
    lines += ["".join(draw.choice('",;a\nb\\ ') for _ in range(draw.randrange(40))) for _ in range(400)]
    lines = [(i, line) for i, line in enumerate(lines)] + [(-1, None)]
    for separator in (",", ";", "|", "\t"):
        frame = spark.createDataFrame(lines, "i int, line string").select("i", I.split_cells(F.col("line"), separator).alias("cells"))
        got = {r.i: r.cells for r in frame.collect()}
        assert got.pop(-1) is None
        for i, line in lines[:-1]:
            assert got[i] == plain_cells(line, separator), (separator, line)


def test_wide_lines(spark, tmp_path):
    """A line of very many quoted cells, of doubled quotes, of open quotes: linear time, no deep stack."""
    n = 100_000
    lines = {"quoted": ",".join(['"a,b"'] * n), "doubled": '"' + '""' * n + '",x', "open": '"' + "a," * n, "pairs": "a," + '"",' * n, "opens": ',""""' * n + '"x'}
    frame = spark.createDataFrame(list(lines.items()), "name string, line string")
    got = {r.name: (r.n, r.first, r.last) for r in frame.select("name", I.split_cells(F.col("line"), ",").alias("c")).select(
        "name", F.size("c").alias("n"), F.get("c", F.lit(0)).alias("first"), F.element_at("c", -1).alias("last")).collect()}
    assert got["quoted"] == (n, "a,b", "a,b") and got["doubled"] == (2, '"' * n, "x") and got["open"] == (n + 1, '"a', "")
    assert got["pairs"] == (n + 2, "a", "") and got["opens"] == (n + 1, "", '"""""x')
    head = ",".join(f'"name {i}"' for i in range(2500))
    write(tmp_path, "wide.csv", head + "\n" + ",".join(f'"{i},5"' for i in range(2500)) + "\n" + ",".join(["7"] * 2500) + "\n")
    report, body = I.ingest(spark, str(tmp_path))
    assert report.first().parsed_columns == 2500 and body.select(F.size("cells")).first()[0] == 2500


def test_names_and_cells(spark):
    assert I.unique_names(spark, ["﻿a", "", "a", None, "Unnamed: 3", "a"]) == ["a", "coluna_2", "a_2", "coluna_4", "coluna_5", "a_3"]
    assert I.unique_names(spark, ["a", "a", "a_2", "a"]) == ["a", "a_3", "a_2", "a_4"]
    from movara.sources.cells import drop_empty

    df = spark.createDataFrame([("x", " ", 1), (" ", "", None)], "a string, b string, c int")
    assert [tuple(r) for r in drop_empty(df).collect()] == [("x", 1)]


def test_json(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert I.read_json(spark, str(tmp_path)).count() == 2
    arrays = tmp_path / "arrays"
    arrays.mkdir()
    (arrays / "records.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert I.read_json(spark, str(arrays), lines=False).count() == 2


def test_quoted_line_breaks(spark, tmp_path):
    write(tmp_path, "quoted.csv", 'nota,valor\n"x\ny, ""z""\n",1\n"a, b,",2\n5" tela,3\n"p\n\nq",4\n')
    write(tmp_path, "stray.csv", 'produto,valor\ncafe,1\n"cha,2\nmate,3\n')
    rows = {}
    for r in I.read_lines(spark, str(tmp_path)).orderBy("line_no").collect():
        rows.setdefault(r.file.rsplit("/", 1)[1], []).append(r.line)
    assert rows["quoted.csv"] == ["nota,valor", '"x\ny, ""z""\n",1', '"a, b,",2', '5" tela,3', '"p\n\nq",4']
    assert rows["stray.csv"] == ["produto,valor", "cafe,1", '"cha,2', "mate,3"]
    _, body = I.ingest(spark, str(tmp_path))
    table = I.table_of(body, ["nota", "valor"]).collect()
    assert sorted(map(tuple, table)) == sorted([('x\ny, "z"', "1"), ("a, b,", "2"), ('5" tela', "3"), ("p\n\nq", "4")])


def test_quotes_over_blocks(spark):
    """Every cut of a file into blocks gives the records that the whole text gives."""
    import csv
    import io

    text = 'a,b\n"1\n2",x\nplain,"y\n\nz"\n"q""\n""r",s\nlast,t\n'
    lines = text.rstrip("\n").split("\n")
    want = [",".join(row) for row in csv.reader(io.StringIO(text))]
    for size in (1, 2, 3, 20):
        data = [("f", (at // size * 100, at), line, "utf-8") for at, line in enumerate(lines)]
        frame = spark.createDataFrame(data, "file string, line_no struct<block: long, pos: long>, line string, encoding string")
        got = I.join_quoted(frame).orderBy("line_no").collect()
        assert [",".join(next(csv.reader(io.StringIO(r.line)))) for r in got] == want, size


def test_json_arrays_and_lines(spark, tmp_path):
    write(tmp_path, "array.json", '\n [\n {"a": 1, "b": "x"},\n {"a": 2, "b": "y"}\n]\n')
    write(tmp_path, "lines.json", '{"a": 3, "c": true}\n{"a": 4}\n')
    got = I.read_json(spark, str(tmp_path))
    assert sorted(r.a for r in got.collect()) == [1, 2, 3, 4] and set(got.columns) == {"a", "b", "c"}
    (tmp_path / "none").mkdir()
    assert I.read_json(spark, str(tmp_path / "none")).count() == 0


def test_files_are_read_once_for_all_steps(spark, tmp_path):
    """Every step after the records are put together reads the written records, and a line is split by its own separator alone."""
    from movara.sources import ingest as module

    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.csv").write_text('codigo;valor\n1;"2;0"\n2;3\n\n')
    (folder / "b.csv").write_text("produto,marca\nx;y,z\n")
    _, body = module.ingest(spark, str(folder))
    assert body.inputFiles() and not any(f.endswith(".csv") for f in body.inputFiles())
    assert sorted((r.separator, r.cells) for r in body.collect()) == [(",", ["x;y", "z"]), (";", ["1", "2;0"]), (";", ["2", "3"])]
