"""The hand-computed golden ledger (FIXTURES section 2) written in the reference's layout."""

import json
import os

CHEQUING = [
    ("2020-01-01", "", "5.25", "COFFEE SHOP"),
    ("2020-01-02", "1000.00", "", "PAYROLL ACME"),
    ("2020-01-03", "", "200.00", "TRANSFER TO VISA"),
    ("2020-01-03", "", "40.00", "GROCER (NORTH)"),
    ("2020-01-05", "", "50.00", "TRANSFER TO VISA"),
    ("2020-01-06", "", "9.99", "UNKNOWN"),
]
VISA = [
    ("2020-01-02", "", "12.00", "COFFEE BAR"),
    ("2020-01-03", "200.00", "", "PAYMENT THANK YOU"),
    ("2020-01-04", "", "30.10", "GROCERXNORTH"),
    ("2020-01-07", "3.00", "1.00", "REFUND MISC"),
]

CONFIG = {
    "default ledger": "home",
    "ledgers": [{
        "ledger name": "home",
        "accounting file": "home_rules",
        "source account directory": "accounts",
        "source accounts": [
            {"account name": "chequing", "opening balance": 100.0},
            {"account name": "visa", "opening balance": -250.0},
        ],
    }],
}

RULES = {
    "derived accounts": [
        {"name": "Coffee", "matchings": [{"account name": "", "strings": ["COFFEE"]}]},
        {"name": "Groceries", "matchings": [{"account name": "", "strings": ["GROCER (NORTH)", "GROCER.NORTH"]}]},
        {"name": "Salary", "matchings": [{"account name": "chequing", "strings": ["PAYROLL"]}],
         "starting value": 10.0},
    ],
    "internal transactions": [
        {"from account": "chequing", "from matchings": ["TRANSFER TO VISA"],
         "to account": "visa", "to matchings": ["PAYMENT THANK YOU"]},
    ],
    "derived account category tree": {"All": ["Living", "Salary"], "Living": ["Coffee", "Groceries"]},
}


def _csv(path, rows):
    with open(path, "w") as f:
        f.write("TransDate,Debit,Credit,Description\n")
        for d, debit, credit, desc in rows:
            f.write(f"{d},{debit},{credit},{desc}\n")


def _json(path, obj):
    with open(path, "w", encoding="utf-8-sig") as f:  # the reference writes a byte-order mark
        json.dump(obj, f)


def write_golden(root):
    for acct, rows in (("chequing", CHEQUING), ("visa", VISA)):
        d = os.path.join(root, "accounts", acct)
        os.makedirs(d, exist_ok=True)
        _csv(os.path.join(d, "statement.csv"), rows)
        with open(os.path.join(d, "notes.txt"), "w") as f:  # not a CSV: ignored
            f.write("ignore me\n")
    _json(os.path.join(root, "LedgerConfiguration.json"), CONFIG)
    _json(os.path.join(root, "home_rules.json"), RULES)
    return root
