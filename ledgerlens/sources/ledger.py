"""The ``ledger`` input bridge: a ledger derived from the driver's order tables.

The driver data has no accounting ledger, so one is derived from
orders x customer x nation.  Every remarks form of the profile (entities,
text signals, structured fields, transaction modes) fires on some rows.
The text stays ASCII so Python, Java and RE2 regex classes agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Parquet scans of the named driver tables (column pruning is left to Catalyst)."""
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


# Description stems by txn_id % 15 (each profile entity occurs in one).
DESCRIPTION_FORMS = (
    "PRLV SEPA EDF ", "VIR RECU ", "URSSAF COTISATIONS ", "PAIEMENT CB ", "Loyer ",
    "DGFIP IMPOTS ", "POLE EMPLOI ", "AGIOS FRAIS BANCAIRE ", "INTERETS CREDITEURS ",
    "PAYPAL EUROPE ", "ORANGE SA ", "AXA ASSURANCE ", "ENCAISSEMENT CLIENT ",
    "HONORAIRES EXPERT ", "REMISE CHEQUE ",
)


# Remark with references of every kind: named, legacy, numeric, doubly escaped, unknown.
ENTITY_REMARK = ("R&eacute;glement &euro; 5 &#233; a&ltimes;b &eacutex &#x20AC;2 &amp;amp; &unknown; LIB: R&eacute;f <br>")


def _case(key: Column, branches: list, default: Column) -> Column:
    """``CASE key WHEN k THEN v ... ELSE default END`` from a list of (k, v)."""
    expr = None
    for k, v in branches:
        expr = F.when(key == k, v) if expr is None else expr.when(key == k, v)
    return expr.otherwise(default)


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def ledger_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed ledger: txn_id, account_code, description, remarks, reference,
    debit, credit, posting_date (timestamp_ntz as stored in the driver Parquet).

    Plan: orders joins customer on the customer key (shuffle join, AQE may turn
    it into a broadcast at runtime when the customer side is measured small; a
    skewed customer is split by AQE skew-join); nation has a fixed 25 rows and
    is broadcast.
    """
    t = read_tables(spark, sf_dir, "orders", "customer", "nation")
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                           "o_orderdate", "o_orderpriority")
    c = t["customer"].select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = t["nation"].select("n_nationkey", "n_regionkey")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")))

    key = F.col("o_orderkey")
    okey, ckey = _s("o_orderkey"), _s("o_custkey")
    # The code follows the description form, the remarks form and the side of the booking, which features
    # can see; a thirteenth of the rows take their group from the order priority instead (noise).  Codes
    # opened in 2001 or retired before 1996 give the temporal split classes seen on one side only.
    year = F.year("o_orderdate")
    group = F.when(key % 13 == 0, F.substring("o_orderpriority", 1, 1)) \
             .otherwise(_s(F.floor(key % 15 / 3) + 1))
    account_code = F.concat(
        group,
        _case(F.col("o_orderstatus"), [("O", F.lit("01")), ("F", F.lit("11"))], F.lit("27")),
        F.lit("0"), _s(F.floor(key % 10 / 2)),
        F.when((year >= 2001) & (group == "5"), F.lit("9"))
         .when((year < 1996) & (group == "4"), F.lit("8")).otherwise(F.lit("0")))
    description = F.concat(
        _case(key % 15, [(i, F.lit(v)) for i, v in enumerate(DESCRIPTION_FORMS[:-1])],
              F.lit(DESCRIPTION_FORMS[-1])),
        F.col("c_mktsegment"))
    remarks = _case(key % 10, [
        (0, F.concat(F.lit("PRLV SEPA CPY:FR"), ckey, F.lit(" RUM : R-"), okey,
                     F.lit(" NBE:"), F.col("c_name"),
                     F.lit("<br />LIB:REGLEMENT FACTURE N"), okey)),
        (1, F.concat(F.lit("VIR SEPA IBE:"),
                     F.when(F.col("o_custkey") % 2 == 0, F.lit("FR")).otherwise(F.lit("DE")),
                     F.lit("76"), ckey, F.lit(" REF:VIR"), okey,
                     F.lit("<br/>Paiement &amp; solde 12,50 EUR"))),
        (2, F.lit("remise cb PAYPAL 25/06/2025")),
        (3, F.lit("NULL")),
        (4, F.lit("")),
        (5, F.concat(F.lit("PAIEMENT CB "), F.col("c_mktsegment"),
                     F.lit(" carte 4,99 eur ORANGE abonnement"))),
        (6, F.concat(F.lit("REMISE CHQ "), okey,
                     F.lit(" cheque especes caisse NPY :"), F.col("c_name"),
                     F.lit(" PDO:FR BIC:BNPAFRPPXXX"))),
        (7, F.concat(F.lit("ECHEANCE PRET "), okey,
                     F.lit(" interets agios frais bancaire RCN: R"), okey,
                     F.lit(" LCC:"), F.col("c_name"), F.lit("&nbsp;LC2 : SUITE<br>"))),
        (8, F.concat(F.lit("virement salaire paie DGFIP impots URSSAF cotisations sociales"
                           " avoir acompte ref# ABCD"), okey)),
    ], F.lit("prelevement loyer bail EDF assurance axa pole emploi encaissement honoraires"
             " consultant stripe 01-02-25 &lt;b&gt;facture&lt;/b&gt;"))
    reference = F.when(key % 7 == 0, F.concat(F.lit("REF"), okey)).otherwise(F.lit(""))
    amount = F.when(key % 4 == 0, F.floor(F.col("o_totalprice") / 100) * 10) \
              .otherwise(F.col("o_totalprice") / 20).cast("double")
    is_open = F.col("o_orderstatus") == "O"
    return j.select(
        key.alias("txn_id"),
        account_code.alias("account_code"),
        description.alias("description"),
        remarks.alias("remarks"),
        reference.alias("reference"),
        F.when(is_open, F.lit(0.0)).otherwise(amount).alias("debit"),
        F.when(is_open, amount).otherwise(F.lit(0.0)).alias("credit"),
        F.col("o_orderdate").alias("posting_date"),
    )


def ledger_raw_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string ledger as a CSV or database would deliver it, with bad amounts,
    bad dates, null text and NA tokens injected on fixed txn_id remainders."""
    led = ledger_frame(spark, sf_dir)
    k = F.col("txn_id")

    def inject(col: Column, faults: list) -> Column:
        """First matching remainder wins; otherwise the clean value."""
        expr = None
        for mod, val in faults:
            cond = k % mod == 0
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        return expr.otherwise(col)

    null = F.lit(None).cast("string")
    return led.select(
        _s("txn_id").alias("txn_id"),
        F.col("account_code"),
        inject(F.col("description"), [(43, null)]).alias("description"),
        inject(F.col("remarks"), [(17, null), (19, F.lit("N/A")), (53, F.lit(ENTITY_REMARK))]).alias("remarks"),
        inject(F.col("reference"), [(47, F.lit("NULL"))]).alias("reference"),
        inject(_s("debit"), [(11, F.lit("abc")), (23, F.lit(" 12.5 ")),
                             (37, F.lit("1e3")), (59, F.lit("NaN")), (61, F.lit("12d")),
                             (67, F.lit("Infinity"))]).alias("debit"),
        inject(_s("credit"), [(13, null)]).alias("credit"),
        inject(F.date_format("posting_date", "yyyy-MM-dd"),
               [(29, F.lit("2025-13-99")), (31, F.lit("15/01/2025")), (41, null)]
               ).alias("posting_date"),
    )
