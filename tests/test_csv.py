import pytest

from tallyspark.operators.profile import column_profile, duplicate_rows, logical_types, merged_profile, quality_warnings
from tallyspark.sources import files, tables


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


SALES = "order_id,sku,amount,active,order_date\n1,00123,10.5,true,2026-01-01\n2,00456,,false,2026-01-02\n3,00789,20.0,true,2026-01-03\n"


def test_sales_types_key_and_typed_sum(spark, tmp_path, rows):
    text = tables.read_csv_text(spark, write(tmp_path, "sales.csv", SALES))
    prof = rows(column_profile(text), "column")
    kinds = {c: p["inferred_type"] for c, p in prof.items()}
    assert kinds == {"order_id": "INTEGER", "sku": "STRING", "amount": "DECIMAL", "active": "BOOLEAN", "order_date": "DATE"}
    assert prof["order_id"]["candidate_key"] and not prof["sku"]["candidate_key"]
    assert prof["amount"]["null_count"] == 1 and prof["amount"]["median"] == 15.25
    typed = tables.typed_load(text, str(tmp_path / "typed"))
    assert [t for _, t in typed.dtypes] == ["bigint", "string", "double", "boolean", "date"]
    assert typed.groupBy().sum("amount").first()[0] == 30.5
    assert [r["sku"] for r in typed.orderBy("order_id").collect()] == ["00123", "00456", "00789"]


def test_dialect_encoding_and_header(spark, tmp_path, rows):
    write(tmp_path, "semi.csv", 'id;name;note\n1;Ada;"a;b"\n2;Bob;"c;d"\n')
    write(tmp_path, "old.csv", "id,name\n1,André\n".encode("cp1252"))
    write(tmp_path, "twice.csv", "id,ID\n1,2\n")
    write(tmp_path, "gap.csv", "id,,amount\n1,2,3\n")
    write(tmp_path, "bin.csv", b"id,name\n1,\x00\x01\n")
    write(tmp_path, "none.csv", "")
    write(tmp_path, "notes.txt", "id\n1\n")
    found = files.inspect_files(files.list_files(spark, str(tmp_path)))
    report = rows(files.dialect_report(found), "file")
    assert report["semi.csv"]["delimiter"] == ";" and report["old.csv"]["encoding"] == "cp1252"
    names = {(r["file"], r["name"]): r["finding"] for r in files.header_audit(found).collect()}
    assert names["twice.csv", "id"] == "duplicate" and names["gap.csv", ""] == "blank" and names["semi.csv", "note"] == "ok"
    verdict = {r["file"]: r["reason"] for r in files.file_admission(found).collect()}
    assert verdict["bin.csv"] == "binary content" and verdict["none.csv"] == "empty file"
    assert verdict["notes.txt"] == "not a .csv file" and verdict["semi.csv"] is None
    text = tables.read_csv_text(spark, str(tmp_path / "old.csv"), encoding="cp1252")
    assert text.first()["name"] == "André"
    assert tables.read_csv_text(spark, str(tmp_path / "semi.csv"), sep=";").first()["note"] == "a;b"


def test_long_rows_are_errors_and_short_rows_are_padded(spark, tmp_path):
    path = write(tmp_path, "ragged.csv", "id,name\n1,a\n2,b,c\n3\n")
    kept = tables.read_csv_text(spark, path, keep_extra=True)
    assert [r["id"] for r in tables.rejected_rows(kept).collect()] == ["2"]
    assert {r["id"]: r["name"] for r in kept.collect()}["3"] is None
    with pytest.raises(Exception, match="more fields"):
        tables.read_csv_text(spark, path).collect()


def test_quoted_line_breaks_are_seen(spark, tmp_path):
    path = write(tmp_path, "breaks.csv", 'id,note\n1,"two\nlines"\n2,plain\n')
    assert tables.has_quoted_breaks(spark, path)
    assert [r["note"] for r in tables.read_csv_text(spark, path).orderBy("id").collect()] == ["two\nlines", "plain"]
    assert not tables.has_quoted_breaks(spark, write(tmp_path, "flat.csv", 'id,note\n1,"a"\n'))


def test_duplicates_dates_missing_words_and_header_only(spark, tmp_path, rows):
    dup = tables.read_csv_text(spark, write(tmp_path, "dup.csv", "id,name\n1,a\n1,a\n2,b\n"))
    assert duplicate_rows(dup).first().asDict() == {"rows": 3, "duplicate_rows": 1, "duplicate_percentage": 33.33}
    vague = tables.read_csv_text(spark, write(tmp_path, "vague.csv", "id,date\n1,03/04/2026\n2,04/05/2026\n"))
    assert rows(logical_types(vague), "column")["date"]["inferred_type"] == "STRING"
    wrong = tables.read_csv_text(spark, write(tmp_path, "wrong.csv", "id,date\n1,2026-02-30\n"))
    assert rows(logical_types(wrong), "column")["date"]["inferred_type"] == "STRING"
    na = tables.read_csv_text(spark, write(tmp_path, "na.csv", "customer_id,region\n1,NA\n2,EU\n"))
    assert rows(column_profile(na), "column")["region"]["null_count"] == 0
    assert rows(logical_types(na, missing=("na",)), "column")["region"]["inferred_type"] == "STRING"
    quality = tables.read_csv_text(spark, write(tmp_path, "q.csv", "id,status,note\n1, ok ,missing\n2,ok,null\n3,ok,x\n"))
    prof = rows(column_profile(quality), "column")
    assert prof["note"]["null_count"] == 2 and prof["status"]["whitespace_value_count"] == 1
    said = [r["warning"] for r in quality_warnings(quality).collect()]
    assert "Column 'status' is constant." in said and "Column 'note' is missing in more than half of the rows." in said
    empty = tables.read_csv_text(spark, write(tmp_path, "h.csv", "order_id,customer_id,amount\n"))
    assert empty.count() == 0 and empty.columns == ["order_id", "customer_id", "amount"]
    assert "CSV contains headers but no data rows." in [r["warning"] for r in quality_warnings(empty).collect()]


def test_folder_profile_reads_each_file_as_a_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "a b.csv", "item_id,v\n1,x\n2,y\n")
    write(folder, "c.csv", "item_id,v\n1,x\n1,x\n")
    write(folder, "d.csv", "k;w\n1; z \n")
    out = tables.csv_folder_profile(files.inspect_files(files.list_files(spark, str(folder), "*.csv"))).collect()
    got = {(r["table"], r["column"]): r for r in out}
    assert set(t for t, _ in got) == {"a_b", "c", "d"}
    assert got["a_b", "item_id"]["candidate_key"] and not got["c", "item_id"]["candidate_key"]
    assert got["d", "w"]["whitespace_value_count"] == 1


def test_fingerprint_json_and_jdbc_options(spark, tmp_path):
    import hashlib

    path = write(tmp_path, "x.csv", SALES)
    got = files.file_fingerprint(files.list_files(spark, path)).first()
    assert got["sha256"] == hashlib.sha256(SALES.encode()).hexdigest() and got["length"] == len(SALES)
    write(tmp_path, "r.json", '{\n "user_goal": "x",\n "data": [{"a": 1, "b": null}, {"a": 2, "b": "t"}]\n}')
    assert sorted(r["a"] for r in tables.json_rows(spark, str(tmp_path / "r.json")).collect()) == [1, 2]
    opts = tables.jdbc_options("mysql", "db", 3306, "shop", "u", "p", "orders", ("id", 0, 100, 4))
    assert opts["url"] == "jdbc:mysql://db:3306/shop" and opts["numPartitions"] == "4" and opts["queryTimeout"] == "30"
    assert "BASE TABLE" in tables.catalog_query("postgresql", "public") and "PRIMARY KEY" in tables.keys_query("mysql")
    assert "referenced_table_name IS NOT NULL" in tables.foreign_keys_query("mysql")


def test_long_rows_are_rejected_even_if_blank(spark, tmp_path):
    path = write(tmp_path, "long.csv", 'id,name\n1,a\n2,b,,x\n3,c,\n4\n5,"d,e"\n')
    kept = tables.read_csv_text(spark, path, keep_extra=True)
    assert sorted(r["id"] for r in tables.rejected_rows(kept).collect()) == ["2", "3"]
    assert sorted((r["id"], r["name"]) for r in kept.where("_extra is null").collect()) == [("1", "a"), ("4", None), ("5", "d,e")]
    with pytest.raises(Exception, match="more fields"):
        tables.read_csv_text(spark, path).collect()


def test_files_with_other_headers_are_an_error(spark, tmp_path):
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("id,name\n1,a\n")
    (folder / "b.csv").write_text("name,id\nb,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv_text(spark, str(folder)).collect()


def test_line_breaks_are_decided_file_by_file(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text('id,note\n1,"two\nlines"\n')
    (folder / "b.csv").write_text("id,note\n2,plain\n")
    assert [f.rsplit("/", 1)[-1] for f in tables.quoted_break_files(spark, str(folder))] == ["a.csv"]
    assert sorted((r["id"], r["note"]) for r in tables.read_csv_text(spark, str(folder)).collect()) == [("1", "two\nlines"), ("2", "plain")]


def test_late_bytes_decide_encoding_and_nul(spark, tmp_path):
    (tmp_path / "late.csv").write_bytes(b"id,name\n" + b"1,a\n" * 40_000 + "2,André\n".encode("cp1252"))
    (tmp_path / "nul.csv").write_bytes(b"id,name\n" + b"1,a\n" * 40_000 + b"2,\x00\n")
    (tmp_path / "wide.csv").write_text(",".join(f"column_{i}" for i in range(9_000)) + "\n" + "1," * 8_999 + "1\n")
    found = {r["path"].rsplit("/", 1)[-1]: r for r in files.inspect_files(files.list_files(spark, str(tmp_path), "*.csv")).collect()}
    assert found["late.csv"]["encoding"] == "cp1252" and found["nul.csv"]["nul"] and not found["late.csv"]["nul"]
    assert len(found["wide.csv"]["header"]) == 9_000


def test_profile_of_several_schemas(spark, rows):
    a = spark.createDataFrame([(1, "x", 2.5), (2, " x ", None), (3, "missing", -1.0)], "id int, word string, size double")
    b = spark.createDataFrame([("007", "y" * 400), ("008", "y" * 400)], "code string, text string")
    found = rows(merged_profile({"one.a": a, "two.a": b, "bare": a.limit(0)}), "schema", "table", "column")
    assert len(found) == 8
    assert {k: found["one", "a", "id"][k] for k in ("rows", "is_unique", "candidate_key", "inferred_type", "ordinal")} == {
        "rows": 3, "is_unique": True, "candidate_key": True, "inferred_type": "INTEGER", "ordinal": 1}
    word = found["one", "a", "word"]
    assert (word["null_count"], word["distinct_count"], word["most"], word["null_pct"]) == (1, 1, 2, 33.33)
    assert (found["one", "a", "size"]["min"], found["one", "a", "size"]["max"]) == (-1.0, 2.5)
    assert found["two", "a", "code"]["candidate_key"] and found["two", "a", "text"]["most"] == 2
    assert found["", "bare", "id"]["rows"] == 0 and found["", "bare", "id"]["inferred_type"] == "UNKNOWN" and not found["", "bare", "id"]["is_unique"]
