"""Independent SQL formulations (DuckDB dialect) of the registered queries.

These texts are the correctness oracle: they restate each operator's
semantics in plain SQL over the driver tables, without the library.  Shared
common table expressions build the ``ledger`` bridge, the raw all-string
ledger and its normalised form.
"""

from __future__ import annotations

from ..operators.profile import Profile

LEDGER_CTE = """
ledger AS (
 SELECT o_orderkey AS txn_id,
  concat(CASE WHEN o_orderkey % 13 = 0 THEN substring(o_orderpriority, 1, 1)
              ELSE CAST(o_orderkey % 15 // 3 + 1 AS VARCHAR) END,
         CASE o_orderstatus WHEN 'O' THEN '01' WHEN 'F' THEN '11' ELSE '27' END,
         '0', CAST(o_orderkey % 10 // 2 AS VARCHAR),
         CASE WHEN year(o_orderdate) >= 2001 AND (CASE WHEN o_orderkey % 13 = 0
                THEN substring(o_orderpriority, 1, 1) ELSE CAST(o_orderkey % 15 // 3 + 1 AS VARCHAR) END) = '5' THEN '9'
              WHEN year(o_orderdate) < 1996 AND (CASE WHEN o_orderkey % 13 = 0
                THEN substring(o_orderpriority, 1, 1) ELSE CAST(o_orderkey % 15 // 3 + 1 AS VARCHAR) END) = '4' THEN '8'
              ELSE '0' END) AS account_code,
  concat(CASE o_orderkey % 15 WHEN 0 THEN 'PRLV SEPA EDF ' WHEN 1 THEN 'VIR RECU '
         WHEN 2 THEN 'URSSAF COTISATIONS ' WHEN 3 THEN 'PAIEMENT CB ' WHEN 4 THEN 'Loyer '
         WHEN 5 THEN 'DGFIP IMPOTS ' WHEN 6 THEN 'POLE EMPLOI ' WHEN 7 THEN 'AGIOS FRAIS BANCAIRE '
         WHEN 8 THEN 'INTERETS CREDITEURS ' WHEN 9 THEN 'PAYPAL EUROPE ' WHEN 10 THEN 'ORANGE SA '
         WHEN 11 THEN 'AXA ASSURANCE ' WHEN 12 THEN 'ENCAISSEMENT CLIENT '
         WHEN 13 THEN 'HONORAIRES EXPERT ' ELSE 'REMISE CHEQUE ' END, c_mktsegment) AS description,
  CASE o_orderkey % 10
   WHEN 0 THEN concat('PRLV SEPA CPY:FR', CAST(o_custkey AS VARCHAR), ' RUM : R-',
               CAST(o_orderkey AS VARCHAR), ' NBE:', c_name, '<br />LIB:REGLEMENT FACTURE N',
               CAST(o_orderkey AS VARCHAR))
   WHEN 1 THEN concat('VIR SEPA IBE:', CASE WHEN o_custkey % 2 = 0 THEN 'FR' ELSE 'DE' END, '76',
               CAST(o_custkey AS VARCHAR), ' REF:VIR', CAST(o_orderkey AS VARCHAR),
               '<br/>Paiement &amp; solde 12,50 EUR')
   WHEN 2 THEN 'remise cb PAYPAL 25/06/2025'
   WHEN 3 THEN 'NULL'
   WHEN 4 THEN ''
   WHEN 5 THEN concat('PAIEMENT CB ', c_mktsegment, ' carte 4,99 eur ORANGE abonnement')
   WHEN 6 THEN concat('REMISE CHQ ', CAST(o_orderkey AS VARCHAR), ' cheque especes caisse NPY :',
               c_name, ' PDO:FR BIC:BNPAFRPPXXX')
   WHEN 7 THEN concat('ECHEANCE PRET ', CAST(o_orderkey AS VARCHAR),
               ' interets agios frais bancaire RCN: R', CAST(o_orderkey AS VARCHAR), ' LCC:',
               c_name, '&nbsp;LC2 : SUITE<br>')
   WHEN 8 THEN concat('virement salaire paie DGFIP impots URSSAF cotisations sociales avoir '
               || 'acompte ref# ABCD', CAST(o_orderkey AS VARCHAR))
   ELSE 'prelevement loyer bail EDF assurance axa pole emploi encaissement honoraires consultant '
        || 'stripe 01-02-25 &lt;b&gt;facture&lt;/b&gt;' END AS remarks,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('REF', CAST(o_orderkey AS VARCHAR)) ELSE '' END AS reference,
  CASE WHEN o_orderstatus = 'O' THEN CAST(0.0 AS DOUBLE)
       ELSE CAST(CASE WHEN o_orderkey % 4 = 0 THEN floor(o_totalprice / 100) * 10
                      ELSE o_totalprice / 20 END AS DOUBLE) END AS debit,
  CASE WHEN o_orderstatus = 'O'
       THEN CAST(CASE WHEN o_orderkey % 4 = 0 THEN floor(o_totalprice / 100) * 10
                      ELSE o_totalprice / 20 END AS DOUBLE)
       ELSE CAST(0.0 AS DOUBLE) END AS credit,
  o_orderdate AS posting_date
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

LEDGER_RAW_CTE = """
ledger_raw AS (
 SELECT CAST(txn_id AS VARCHAR) AS txn_id, account_code,
  CASE WHEN txn_id % 43 = 0 THEN NULL ELSE description END AS description,
  CASE WHEN txn_id % 17 = 0 THEN NULL WHEN txn_id % 19 = 0 THEN 'N/A'
       WHEN txn_id % 53 = 0 THEN 'R&eacute;glement &euro; 5 &#233; a&ltimes;b &eacutex &#x20AC;2 &amp;amp; &unknown; LIB: R&eacute;f <br>'
       ELSE remarks END AS remarks,
  CASE WHEN txn_id % 47 = 0 THEN 'NULL' ELSE reference END AS reference,
  CASE WHEN txn_id % 11 = 0 THEN 'abc' WHEN txn_id % 23 = 0 THEN ' 12.5 '
       WHEN txn_id % 37 = 0 THEN '1e3' WHEN txn_id % 59 = 0 THEN 'NaN' WHEN txn_id % 61 = 0 THEN '12d'
       WHEN txn_id % 67 = 0 THEN 'Infinity' ELSE CAST(debit AS VARCHAR) END AS debit,
  CASE WHEN txn_id % 13 = 0 THEN NULL ELSE CAST(credit AS VARCHAR) END AS credit,
  CASE WHEN txn_id % 29 = 0 THEN '2025-13-99' WHEN txn_id % 31 = 0 THEN '15/01/2025'
       WHEN txn_id % 41 = 0 THEN NULL ELSE strftime(posting_date, '%Y-%m-%d') END AS posting_date
 FROM ledger)"""

PREPARED_CTE = """
prepared AS (
 SELECT CAST(txn_id AS BIGINT) AS txn_id, account_code,
  coalesce(description, '') AS description, coalesce(remarks, '') AS remarks,
  coalesce(reference, '') AS reference,
  CASE WHEN regexp_full_match(trim(debit), '[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?')
       THEN coalesce(TRY_CAST(trim(debit) AS DOUBLE), 0.0) ELSE 0.0::DOUBLE END AS debit,
  CASE WHEN regexp_full_match(trim(credit), '[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?')
       THEN coalesce(TRY_CAST(trim(credit) AS DOUBLE), 0.0) ELSE 0.0::DOUBLE END AS credit,
  TRY_CAST(trim(posting_date) AS TIMESTAMP) AS posting_date,
  substring(account_code, 1, 6) AS target
 FROM ledger_raw)"""

# The textbook temporal split: global row order (posting_date, txn_id).
SPLIT_CTE = """
led6 AS (SELECT *, substring(account_code, 1, 6) AS target FROM ledger),
ranked AS (
 SELECT *, row_number() OVER (ORDER BY posting_date, txn_id) AS rn,
        count(*) OVER () AS n FROM led6 WHERE posting_date IS NOT NULL),
labelled AS (
 SELECT * EXCLUDE (rn, n), CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'val' END AS part
 FROM ranked)"""


RAW_SPLIT_CTE = """
ranked AS (
 SELECT *, row_number() OVER (ORDER BY posting_date, txn_id) AS rn,
        count(*) OVER () AS n FROM prepared WHERE posting_date IS NOT NULL),
labelled AS (
 SELECT * EXCLUDE (rn, n), CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'val' END AS part
 FROM ranked)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def ledger_sql(body: str) -> str:
    return with_ctes(LEDGER_CTE, body=body)


def raw_sql(body: str) -> str:
    return with_ctes(LEDGER_CTE, LEDGER_RAW_CTE, body=body)


def prepared_sql(body: str) -> str:
    return with_ctes(LEDGER_CTE, LEDGER_RAW_CTE, PREPARED_CTE, body=body)


def split_sql(body: str) -> str:
    return with_ctes(LEDGER_CTE, SPLIT_CTE, body=body)


def raw_split_sql(body: str) -> str:
    return with_ctes(LEDGER_CTE, LEDGER_RAW_CTE, PREPARED_CTE, RAW_SPLIT_CTE, body=body)


# ------------------------------------------------------------- text (SQL form)
WS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")


def sql_collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}', ' ', 'g'))"


def sql_decode(expr: str) -> str:
    out = expr
    for pat, rep in (("&ltimes;", "⋉"), ("&eacute;?", "é"), ("&euro;", "€"), ("&#233;?", "é"), ("&#x20AC;?", "€"),
                     ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "'"),
                     ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;?", " "),
                     ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        rep_sql = rep.replace("'", "''")
        out = f"regexp_replace({out}, '{pat}', '{rep_sql}', 'g')"
    return out


def sql_strip_html(expr: str) -> str:
    body = sql_decode(expr)
    body = f"regexp_replace({body}, '<br{WS[:-1]}*/?>', ' ', 'gi')"
    body = f"regexp_replace({body}, '<[^>]+>', ' ', 'g')"
    return (f"CASE WHEN {expr} IS NULL OR {expr} = '' OR {expr} = 'NULL' THEN '' "
            f"ELSE {sql_collapse(body)} END")


def sql_normalize(expr: str, accents: bool = True) -> str:
    keep = "a-z0-9" + ("àâäéèêëïîôùûüçœæ" if accents else "")
    t = f"regexp_replace(lower(coalesce({expr}, '')), '{WS}', ' ', 'g')"
    t = f"regexp_replace({t}, '[^{keep} \\-]', ' ', 'g')"
    return sql_collapse(t)


def sql_clean_extract(expr: str) -> str:
    body = f"replace({sql_decode(expr)}, '&nbsp;', ' ')"
    return (f"CASE WHEN {expr} IS NULL OR {expr} = '' OR {expr} = 'NULL' OR lower({expr}) = 'nan' "
            f"THEN '' ELSE {sql_collapse(body)} END")


def sql_strip_accents(expr: str) -> str:
    return f"translate({expr}, 'àâäéèêëïîôùûüç', 'aaaeeeeiiouuuc')"


# -------------------------------------------------------- profile (SQL form)
def _q(s: str) -> str:
    return s.replace("'", "''")


def sql_flag(cond: str) -> str:
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS INTEGER)"


def profile_sql_columns(p: Profile, rem: str = "remarks", desc: str = "description",
                        amount: str = "amount", date: str = "posting_date",
                        cmt: str = "remarks") -> dict[str, list[tuple[str, str]]]:
    """Each profile rule restated as a DuckDB expression, by family."""
    rem_l = f"lower(coalesce({rem}, ''))"
    desc_l = f"lower(coalesce({desc}, ''))"
    c = sql_clean_extract(cmt)
    c_l = f"lower({c})"
    amt = f"coalesce(abs(CAST({amount} AS DOUBLE)), 0.0)"
    mon, day = f"month({date})", f"day({date})"

    def rx(text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{_q(pattern)}', 'i')"

    fam: dict[str, list[tuple[str, str]]] = {
        "entity_remarks": [(f"ent_{n}", sql_flag(rx(rem_l, "|".join(v))))
                           for n, v in p.entities.items()],
        "text_signal": [(n, sql_flag(rx(rem_l, v))) for n, v in p.text_signals.items()],
        "entity_description": [(f"desc_ent_{n}", sql_flag(rx(desc_l, "|".join(v))))
                               for n, v in p.entities.items()],
        "amount": [], "fiscal": [], "structured": [], "vat": [],
    }
    if p.has_amounts:
        fam["amount"].append(("amt_log_scale", f"CAST(least(greatest(floor(log10({amt} + 1)), 0), "
                                               f"{p.log_clip_max}) AS DOUBLE)"))
        for d in p.round_divisors:
            fam["amount"].append((f"divisible_by_{d}", sql_flag(f"{amt} % {float(d)!r} = 0")))
        for n, (lo, hi) in p.buckets.items():
            conds = ["TRUE"]
            if lo is not None:
                conds.append(f"{amt} >= {lo!r}")
            if hi is not None:
                conds.append(f"{amt} < {hi!r}")
            fam["amount"].append((f"amt_{n}", sql_flag(" AND ".join(conds))))
        for n, (lo, hi) in p.named_ranges.items():
            fam["amount"].append((f"{n}_band", sql_flag(f"{amt} >= {lo!r} AND {amt} <= {hi!r}")))
    for n, w in p.fiscal.items():
        conds = ["TRUE"]
        if w.months is not None:
            conds.append(f"{mon} IN ({', '.join(str(m) for m in w.months)})")
        if w.min_day is not None:
            conds.append(f"{day} >= {w.min_day}")
        if w.max_day is not None:
            conds.append(f"{day} <= {w.max_day}")
        fam["fiscal"].append((f"fiscal_{n}", sql_flag("coalesce(" + " AND ".join(conds) + ", FALSE)")))
    if p.has_structured:
        present = {n: rx(c, pat) for n, pat in p.fields.items()}
        fam["structured"] += [(f"has_{n}", sql_flag(v)) for n, v in present.items()]
        fam["structured"].append(("is_sepa", sql_flag(
            "(" + " OR ".join(list(present.values()) + [f"contains({c_l}, 'sepa')"]) + ")")))
        mode = "CASE " + " ".join(
            "WHEN " + " OR ".join(f"contains({c_l}, '{_q(t)}')" for t in trig) + f" THEN '{m}'"
            for m, trig in p.modes) + f" ELSE '{p.default_mode}' END"
        for m in [m for m, _ in p.modes] + [p.default_mode]:
            fam["structured"].append((f"txn_type_{m}", sql_flag(f"({mode}) = '{m}'")))
        for n, r in p.derived.items():
            val = f"regexp_extract({c}, '{_q(p.fields[r.field])}', 1, 'i')"
            fam["structured"].append((n, sql_flag(
                f"starts_with(upper(CASE WHEN {present[r.field]} THEN {val} ELSE '' END), "
                f"'{_q(r.value.upper())}')")))
    if p.has_vat:
        for r in p.vat_rates:
            ht = f"({amt} / CAST({1.0 + r!r} AS DOUBLE))"
            fam["vat"].append((p.vat_label(r), sql_flag(
                f"abs({ht} - round_even({ht}, 0)) <= CAST({p.vat_tolerance!r} AS DOUBLE) "
                f"AND {amt} > 0")))
    return fam


def sql_mode(p: Profile, cmt: str = "remarks") -> str:
    c_l = f"lower({sql_clean_extract(cmt)})"
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({c_l}, '{_q(t)}')" for t in trig) + f" THEN '{m}'"
        for m, trig in p.modes) + f" ELSE '{p.default_mode}' END"
