"""A small raw file with planted, hand-counted behaviour: 40 customers, 6 months, 235 rows.

Everyone holds the current account, is active and joined in 2012, except:

 1  credit card from m2                      10  income "         NA", province with a comma
 2  e-account until m2                       11  seniority -999999
 3  absent in m2, direct debit from m3       12  two flags NA in m1
 4  e-account from m1, credit card from m4   13  age 115
 5  e-account from m1, direct debit from m3  14  no join date
 6  e-account in m1, m2 and from m4          15  inactive
 7  joins 2015-03-05, first seen in m2,      16  payroll and direct debit
    payroll account and payroll from m4      17  joined 2015-01-10
 8  joined 2015-01-20, last seen in m3       18  direct debit
 9  income empty
"""

from __future__ import annotations

import csv
import io

from panelmill.schema import Catalogue, LadderStep
from panelmill.sources.holdings_file import ATTRIBUTE_COLUMNS, HOLDINGS_CATALOGUE

CUSTOMERS = range(1, 41)
MONTHS = [f"2015-{number:02d}" for number in range(1, 7)]
FLAGS = [product.code for product in HOLDINGS_CATALOGUE.products]
COLUMNS = [*ATTRIBUTE_COLUMNS, *FLAGS]
CURRENT, CARD, E_ACCOUNT = "ind_cco_fin_ult1", "ind_tjcr_fin_ult1", "ind_ecue_fin_ult1"
DEBIT, PAYROLL_ACCOUNT, PAYROLL, PENSION = (
    "ind_recibo_ult1",
    "ind_cno_fin_ult1",
    "ind_nomina_ult1",
    "ind_nom_pens_ult1",
)
CATALOGUE = Catalogue(
    HOLDINGS_CATALOGUE.products,
    (
        LadderStep("Current account", (CURRENT,)),
        LadderStep("Debit or e-account", (DEBIT, E_ACCOUNT)),
        LadderStep("Credit card", (CARD,)),
    ),
)

# customer -> months present (default all)
PRESENT = {3: {0, 1, 3, 4, 5}, 7: {2, 3, 4, 5}, 8: {0, 1, 2, 3}}
# customer -> flag -> months held
ALWAYS = set(range(6))
HOLDS = {
    1: {CARD: {2, 3, 4, 5}},
    2: {E_ACCOUNT: {0, 1, 2}},
    3: {DEBIT: {3, 4, 5}},
    4: {E_ACCOUNT: {1, 2, 3, 4, 5}, CARD: {4, 5}},
    5: {E_ACCOUNT: {1, 2, 3, 4, 5}, DEBIT: {3, 4, 5}},
    6: {E_ACCOUNT: {1, 2, 4, 5}},
    7: {PAYROLL_ACCOUNT: {4, 5}, PAYROLL: {4, 5}},
    16: {PAYROLL: ALWAYS, DEBIT: ALWAYS},
    18: {DEBIT: ALWAYS},
}
# customer -> attribute -> raw text
TEXT = {
    7: {"fecha_alta": "2015-03-05", "ind_nuevo": " 1"},
    8: {"fecha_alta": "2015-01-20"},
    9: {"renta": ""},
    10: {"renta": "         NA", "nomprov": "CORUÑA, A", "cod_prov": "15"},
    11: {"antiguedad": "-999999"},
    13: {"age": "115"},
    14: {"fecha_alta": ""},
    15: {"ind_actividad_cliente": " 0"},
    17: {"fecha_alta": "2015-01-10"},
}
# Spellings of the customer type by month, and what they mean.
TYPE_TEXT = ["1", "1.0", " 2", "p", "3.0", "9"]
TYPE_VALUE = ["1", "1", "2", "P", "3", None]
CHANNELS = ["KAT", "KAT", "KAT", "KFC", "KFC", "KHE"]

ADOPTIONS = {
    (1, 2, CARD),
    (4, 1, E_ACCOUNT),
    (4, 4, CARD),
    (5, 1, E_ACCOUNT),
    (5, 3, DEBIT),
    (6, 1, E_ACCOUNT),
    (6, 4, E_ACCOUNT),
    (7, 4, PAYROLL_ACCOUNT),
    (7, 4, PAYROLL),
}
REPEATS = {(6, 4, E_ACCOUNT)}
ATTRITIONS = {(2, 3, E_ACCOUNT), (6, 3, E_ACCOUNT)}
GAP_CHANGES = {(3, 3, 2, DEBIT, "adoption")}
ROWS_PER_MONTH = [39, 39, 39, 40, 39, 39]


def raw_row(customer: int, month: int) -> dict[str, str]:
    row = {
        "fecha_dato": f"{MONTHS[month]}-28",
        "ncodpers": str(customer),
        "ind_empleado": "N",
        "pais_residencia": "ES",
        "sexo": "V" if customer % 2 else "H",
        "age": str(30 + customer % 20).rjust(4),
        "fecha_alta": "2012-08-10",
        "ind_nuevo": " 0",
        "antiguedad": str(20 + customer).rjust(7),
        "indrel": " 1",
        "indrel_1mes": TYPE_TEXT[month],
        "tiprel_1mes": "A",
        "indresi": "S",
        "indext": "N",
        "canal_entrada": CHANNELS[customer % len(CHANNELS)],
        "indfall": "N",
        "tipodom": " 1",
        "cod_prov": "28",
        "nomprov": "MADRID",
        "ind_actividad_cliente": " 1",
        "renta": f"{10000 + 100 * customer}.5",
        "segmento": "02 - RETAIL" if customer % 3 else "01 - TOP",
    }
    row.update(TEXT.get(customer, {}))
    row.update({flag: "0" for flag in FLAGS})
    row[CURRENT] = "1"
    for flag, months in HOLDS.get(customer, {}).items():
        row[flag] = str(int(month in months))
    if customer == 12 and month == 1:
        row[PAYROLL] = row[PENSION] = "NA"
    return row


def raw_rows() -> list[dict[str, str]]:
    return [
        raw_row(customer, month)
        for month in range(6)
        for customer in CUSTOMERS
        if month in PRESENT.get(customer, ALWAYS)
    ]


def csv_text(rows: list[dict[str, str]] | None = None, columns: list[str] | None = None) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    columns = columns or COLUMNS
    writer.writerow(columns)
    for row in raw_rows() if rows is None else rows:
        writer.writerow([row.get(name, "") for name in columns])
    return out.getvalue()
