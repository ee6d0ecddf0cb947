"""File edge: custom bank formats (S3), JSON account and frame files (S4-S6), CSV dump (S17),
ledger data by name (L18), folder names, headers and unreadable cells (S1, V8)."""

import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from golden import write_golden
from tallyforge.operators import transfers as TR
from tallyforge.plans.ledgers import ledger_data, ledger_from_folders
from tallyforge.sources.csv_folders import BankFormat, read_account_folders, unpaired_to_csv
from tallyforge.sources.json_io import (read_account_files, read_account_headers, read_frame_file,
                                        write_transactions_jsonl)


def test_custom_bank_format(spark, workdir):
    d = os.path.join(workdir, "acc", "card")
    os.makedirs(d)
    with open(os.path.join(d, "export.csv"), "w") as f:
        f.write("when;amount;text\n03/01/2020;-12.50;LUNCH\n04/01/2020;100;REFUND\n")

    def card(df):
        amt = F.col("amount").cast("decimal(20,2)")
        return df.select(F.to_date("when", "dd/MM/yyyy").alias("TransDate"),
                         F.when(amt < 0, -amt).alias("Credit"), F.when(amt >= 0, amt).alias("Debit"),
                         F.col("text").alias("Description"), "_account_dir", "_file", "_block", "_row")

    fmt = BankFormat(name="card", options={"header": "true", "sep": ";"}, transform=card)
    raw = read_account_folders(spark, os.path.join(workdir, "acc"), {"card": "card", "empty": "card"},
                               {"card": fmt})
    got = sorted((r["account"], str(r["date"]), r["amount"], r["description"]) for r in raw.collect())
    assert got == [("card", "2020-01-03", -1250, "LUNCH"), ("card", "2020-01-04", 10000, "REFUND")]


def test_account_json_roundtrip(spark, workdir):
    p = os.path.join(workdir, "chequing.json")
    doc = {"name": "chequing", "start_value": 100.0, "end_value": 794.76, "transactions": [
        {"ID": "a", "date": "2020-01-01", "delta": -5.25, "description": "COFFEE", "timestamp": 1577836800.0},
        {"ID": "b", "date": "2020-01-02", "delta": 1000.0, "description": "PAY", "timestamp": 1577923200.0}]}
    with open(p, "w", encoding="utf-8-sig") as f:
        json.dump(doc, f)
    rows = read_account_files(spark, p).orderBy("seq").collect()
    assert [(r["seq"], r["id"], r["amount"], r["epoch"]) for r in rows] == [(0, "a", -525, 1577836800),
                                                                           (1, "b", 100000, 1577923200)]
    h = read_account_headers(spark, p).first()
    assert h["start_value"] == 10000 and h["end_value"] == 79476
    frame = os.path.join(workdir, "frame.json")
    with open(frame, "w", encoding="utf-8-sig") as f:
        json.dump({"frame": [{"x": 1}, {"x": 2}]}, f)
    schema = T.StructType([T.StructField("x", T.LongType())])
    assert read_frame_file(spark, frame, schema).count() == 2


def test_ledger_files_out(spark, workdir):
    lf = ledger_from_folders(spark, write_golden(workdir))
    out = os.path.join(workdir, "out")
    write_transactions_jsonl(lf.txn, os.path.join(out, "txn"))
    back = spark.read.json(os.path.join(out, "txn"))
    assert back.count() == 10 and set(back.columns) >= {"ID", "date", "delta", "description", "timestamp", "account"}
    unpaired_to_csv(TR.unpaired(lf.transfer_matches), os.path.join(out, "unpaired"))
    assert spark.read.option("header", "true").csv(os.path.join(out, "unpaired")).count() == 1
    assert ledger_data(lf, "LedgerEntries").count() == 6
    assert ledger_data(lf, "UnaccountedTransactions").count() == 3
    assert ledger_data(lf, "nope").count() == 0


def test_folder_names_headers_and_unreadable_cells(spark, workdir):
    """Names with blanks, percent and plus signs; two header orders; cells that are no date or amount."""
    from tallyforge.operators.identity import quarantine
    names = ["My Visa", "100%", "a+b", "Ünï", "plain"]
    for k, name in enumerate(names):
        d = os.path.join(workdir, "acc", name)
        os.makedirs(d)
        order = ["TransDate", "Debit", "Credit", "Description"] if k % 2 else ["Description", "Credit", "TransDate", "Debit"]
        rows = [{"TransDate": "2020-01-02", "Debit": "5.00", "Credit": "", "Description": "in"},
                {"TransDate": "2020-01-03", "Debit": "", "Credit": "7.00", "Description": "out"},
                {"TransDate": "soon", "Debit": "1.00", "Credit": "", "Description": "no date"},
                {"TransDate": "2020-01-05", "Debit": '"1,234.50"', "Credit": "7.00", "Description": "no amount"},
                {"TransDate": "2020-01-06", "Debit": "3.00", "Credit": "x", "Description": "no amount"},
                {"TransDate": "2020-01-07", "Debit": "", "Credit": "", "Description": "empty"}]
        with open(os.path.join(d, "export.csv"), "w", encoding="utf-8") as f:
            f.write("\n".join([",".join(order), *[",".join(r[c] for c in order) for r in rows]]) + "\n")
    want = sorted((n, a, x) for n in names for a, x in ((500, "in"), (-700, "out")))
    bad = sorted((n, r) for n in names for r in ("no date", "no amount", "no amount", "no amount"))
    from tallyforge.operators.identity import identify
    from tallyforge.sources.csv_folders import read_selected_folders
    root = os.path.join(workdir, "acc")
    for raw in (read_account_folders(spark, root, names), read_selected_folders(spark, root, spark.createDataFrame([(n,) for n in names], "account string"))):
        assert sorted((r.account, r.amount, r.description) for r in identify(raw).collect()) == want
        assert sorted((r.account, r.reason) for r in quarantine(raw).collect()) == bad


def test_configuration_edges(spark, workdir):
    from tallyforge.sources.json_io import read_account_mapping, read_ledger_configuration, select_ledger
    assert read_ledger_configuration(spark, os.path.join(workdir, "missing.json")).count() == 0
    m = read_account_mapping(spark, os.path.join(workdir, "missing_rules.json"))
    assert m.derived == [] and m.transfers == [] and m.category_tree() == {"All": []}
    root = write_golden(workdir)
    cfg = read_ledger_configuration(spark, f"{root}/LedgerConfiguration.json")
    assert {r["account"]: r["start_value"] for r in select_ledger(cfg).collect()} == {"chequing": 10000, "visa": -25000}
    assert select_ledger(cfg, "other").count() == 0
    rules = read_account_mapping(spark, f"{root}/home_rules.json")
    assert [r.name for r in rules.derived] == ["Coffee", "Groceries", "Salary"]
    assert rules.derived[2].start_value == 1000 and rules.derived[0].is_universal
    assert rules.tree == {"All": ["Living", "Salary"], "Living": ["Coffee", "Groceries"]}


def test_json_exports_read_back(spark, workdir):
    from tallyforge.sources.json_io import read_account_mapping, write_account_files, write_account_mapping, write_frame_files
    root = write_golden(workdir)
    lf = ledger_from_folders(spark, root)
    bal = lf.source_balances().select("name", "start_value", "end_value")
    out = os.path.join(workdir, "accounts_out")
    write_account_files(lf.txn, bal, out, rows_per_file=4)  # chequing takes two files
    cols = ["account", "seq", "id", "date", "epoch", "amount", "description"]
    assert sorted(map(tuple, read_account_files(spark, out).select(*cols).collect())) == sorted(map(tuple, lf.txn.select(*cols).collect()))
    heads = read_account_headers(spark, out).select("name", "start_value", "end_value")
    assert sorted(map(tuple, heads.collect())) == sorted(map(tuple, bal.collect()))
    frame = os.path.join(workdir, "frame_out")
    rows = spark.range(25).selectExpr("id as x", "cast(id % 3 as string) as y")
    write_frame_files(rows, frame, rows_per_file=4)
    assert sorted(map(tuple, read_frame_file(spark, frame, rows.schema).collect())) == sorted(map(tuple, rows.collect()))
    mapping = read_account_mapping(spark, f"{root}/home_rules.json")
    rules = os.path.join(workdir, "rules_out")
    write_account_mapping(spark, mapping, rules)
    assert read_account_mapping(spark, rules) == mapping


def test_strict_load_and_all_ledgers(spark, workdir):
    import pytest

    from tallyforge.plans.ledgers import all_ledgers_from_folders, build_ledger, with_ledger
    root = write_golden(workdir)
    lf = ledger_from_folders(spark, root, strict=True)
    assert lf.tree_problems().count() == 0
    lf.mapping.tree = {"All": ["Living", "Salary", "Nobody"], "Living": ["Coffee", "Coffee"]}
    found = {(r.check, r.subject) for r in lf.tree_problems().collect()}
    assert {("duplicate child", "Coffee"), ("not one account", "Nobody"), ("derived account not in tree", "Groceries")} <= found
    with pytest.raises(ValueError, match="Nobody"):
        build_ledger(spark, "x", lf.raw, lf.source_accounts, lf.mapping, strict=True)
    both = all_ledgers_from_folders(spark, root)
    assert {r.ledger for r in with_ledger(both, "txn").select("ledger").distinct().collect()} == {x.name for x in both}


def test_long_account_file_is_read_by_ranges(spark, workdir):
    """Parts of 40 to 700 bytes: borders inside strings, escapes and elements; arrays of other fields around."""
    hard = ['q"uote', "back\\", 'a\\"b', "[{]}", '"transactions": [', "Ünï 漢", "", "\\\\\\", "x" * 300]
    rows = [{"ID": f"i{k}", "date": "2020-01-02", "delta": k / 4, "description": hard[k % len(hard)], "timestamp": 1577836800.0 + k}
            for k in range(60)]
    docs = {"a b": {"notes": [{"x": [1]}], "name": "a b", "start_value": 1.5, "transactions": rows, "end_value": 2.5, "tail": [{"y": 1}]},
            "none": {"name": "none", "start_value": 1.0, "end_value": 1.0, "transactions": []},
            "bare": {"name": "bare", "start_value": 3.0, "end_value": 3.0}}
    for name, doc in docs.items():
        with open(os.path.join(workdir, f"{name}.json"), "w", encoding="utf-8-sig") as f:
            json.dump(doc, f, ensure_ascii=name != "a b", indent=2 if name == "a b" else None)
    want = [("a b", k, r["ID"], r["description"], 25 * k) for k, r in enumerate(rows)]
    for size in (40, 211, 1 << 20):
        got = read_account_files(spark, workdir, part_bytes=size).orderBy("seq").collect()
        assert [(r.account, r.seq, r.id, r.description, r.amount) for r in got] == want
    heads = read_account_headers(spark, workdir, part_bytes=97).collect()
    assert sorted((r.name, r.start_value, r.end_value) for r in heads) == [("a b", 150, 250), ("bare", 300, 300), ("none", 100, 100)]


def test_headers_are_read_from_heads_only(spark, workdir):
    """Quoted line feeds and blank lines before and in headers, a header past the first read, an empty file."""
    from tallyforge.sources.byte_ranges import PROBE_BYTES, first_records, list_files
    long = ",".join(["TransDate", "Credit", "Debit", "Description", "m" * 2 * PROBE_BYTES])
    texts = {"a": '\ufeff"TransDate","Credit","Debit","Description","two\nlines"\n2020-01-02,,5.00,in,x\n',
             "b": "\r\n \r\n" + long + "\r\n2020-01-03,7.00,,out\r\n", "c": "", "d": "\n\n",
             "e": "Description,Credit,TransDate,Debit\nDescription,Credit,TransDate,Debit\nlast,,2020-01-04,1.00\n"}
    for name, text in texts.items():
        os.makedirs(os.path.join(workdir, "acc", name))
        with open(os.path.join(workdir, "acc", name, "x.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    heads = first_records(list_files(spark, os.path.join(workdir, "acc", "*", "*.csv"))).collect()
    assert {r.uri.split("/")[-2]: r.value for r in heads} == {
        "a": '"TransDate","Credit","Debit","Description","two\nlines"', "b": long, "e": "Description,Credit,TransDate,Debit"}
    fmt = BankFormat(options={"header": "true", "multiLine": "true"})
    raw = read_account_folders(spark, os.path.join(workdir, "acc"), {n: "lines" for n in texts}, {"lines": fmt})
    got = sorted((r.account, r.amount, r.description) for r in raw.where("date is not null").collect())
    assert got == [("a", 500, "in"), ("b", -700, "out"), ("e", 100, "last")]
