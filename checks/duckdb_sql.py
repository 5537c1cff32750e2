"""The same results in DuckDB SQL, written independently of the Spark code.

Each query is a SELECT over named steps; `_sql` puts the steps it needs in front.
"""

from __future__ import annotations

import re

UPDAY = "1998-01-15"


def _receipt_select(member: str, joins: str) -> str:
    return f"""
SELECT CAST(l_shipdate AS DATE) AS salesday,
       CAST(l_suppkey % 2 AS INTEGER) AS store_cd, {member}
       l_partkey % 5 AS jan,
       CAST(1 + (CAST(l_quantity AS INTEGER) % 8) AS DOUBLE) AS salescnt,
       CAST(CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 0 ELSE 1 END
            * (1 + (CAST(l_quantity AS INTEGER) % 8))
            * (100 + 10 * (l_partkey % 5)
               + 10 * CAST(FLOOR(DATE_DIFF('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))
                                 / (150 + 25 * (l_partkey % 5))) AS INTEGER)) AS DOUBLE) AS salesamount,
       'lv3' AS lv3_nm, 'lv4' AS lv4_nm,
       CASE WHEN l_partkey % 5 < 3 THEN 'milk' ELSE 'tea' END AS lv5_nm,
       'item ' || CAST(l_partkey % 5 AS VARCHAR) AS name
FROM lineitem {joins}"""


CASE = "store_cd, lv4_nm, lv5_nm, jan, pprice, aprice, astart"
ITEM = "store_cd, lv4_nm, lv5_nm, jan"


def _same(a: str, b: str, columns: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in columns.split(", "))


def _runs(prices: str) -> str:
    return f"""
SELECT store_cd, jan, MIN(salesday) AS "start", MAX(salesday) AS "end", price,
       CAST(SUM(pos) AS BIGINT) AS pos,
       CAST(DATE_DIFF('day', MIN(salesday), MAX(salesday)) + 1 AS INTEGER) AS plen
FROM (SELECT *, SUM(changed) OVER (PARTITION BY store_cd, jan ORDER BY salesday, price
                                   ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, CASE WHEN price <> LAG(price) OVER (PARTITION BY store_cd, jan
                                                          ORDER BY salesday, price)
                           THEN 1 ELSE 0 END AS changed FROM {prices}))
GROUP BY store_cd, jan, run, price"""


def _up(runs: str) -> str:
    lead = lambda c: f'LEAD("{c}") OVER (PARTITION BY store_cd, jan ORDER BY "start", "end", price)'
    return f"""
SELECT store_cd, jan, "start" AS pstart, "end" AS pend, nstart AS astart, nend AS aend,
       price AS pprice, nprice AS aprice, pos AS ppos, npos AS apos, plen AS pplen, nplen AS aplen
FROM (SELECT *, {lead('start')} AS nstart, {lead('end')} AS nend, {lead('price')} AS nprice,
             {lead('pos')} AS npos, {lead('plen')} AS nplen FROM {runs})
WHERE plen >= 75 AND price < nprice AND DATE_DIFF('day', "end", nstart) <= 3 AND nplen >= 45"""


def _zero(step: str) -> str:
    return f"""
SELECT store_cd, jan, 'same' AS type, astart, price AS pprice, price AS aprice
FROM (SELECT *, CAST(UNNEST(GENERATE_SERIES("start" + INTERVAL 82 DAY, {step},
                                            INTERVAL 42 DAY)) AS DATE) AS astart
      FROM periods WHERE DATE_DIFF('day', "start", "end") >= 126)
WHERE astart <= "end" """


def _label(scope: str) -> str:
    own = "AND c.astart = b.astart AND c.pprice = b.pprice AND c.aprice = b.aprice" \
        if scope == "case" else ""
    window = "d.salesday BETWEEN c.astart + INTERVAL 7 DAY AND c.astart + INTERVAL 34 DAY"
    own_lv5 = own and own + " AND c.jan = b.jan"
    return f"""
SELECT b.*,
       EXISTS (SELECT 1 FROM days d JOIN cases c ON {_same('c', 'd', ITEM)} AND {window}
               WHERE {_same('c', 'b', ITEM)} AND d.uid = b.uid {own}) AS label_jan,
       EXISTS (SELECT 1 FROM days d JOIN cases c ON {_same('c', 'd', 'store_cd, lv4_nm, lv5_nm')}
                                                AND {window}
               WHERE {_same('c', 'b', 'store_cd, lv4_nm, lv5_nm')} AND d.uid = b.uid {own_lv5})
         AS label_lv5
FROM base b"""


def _spent(level: str, columns: str) -> str:
    """Purchases in the 63 days before the change, per row of the base."""
    return f"""
SELECT b.{', b.'.join(CASE.split(', '))}, b.uid, MAX(d.salesday) AS last_day,
       COUNT(DISTINCT d.salesday) AS f, SUM(d.salesamount) AS m
FROM base b JOIN days d ON {_same('b', 'd', columns)} AND d.uid = b.uid
     AND d.salesday BETWEEN b.astart - INTERVAL 63 DAY AND b.astart - INTERVAL 1 DAY
GROUP BY ALL"""


def _scores(form: str, by: str, suffix: str = "") -> str:
    over = lambda c, o: f"({by}ORDER BY {c}{suffix} {o})"
    if form == "percent":
        rank = lambda c, o: f"PERCENT_RANK() OVER {over(c, o)}"
    else:
        rank = lambda c, o: f"RANK() OVER {over(c, o)} / CAST(COUNT(*) OVER ({by}) AS DOUBLE)"
    return (f"{rank('r', 'DESC NULLS LAST')} AS rscore{suffix}, "
            f"{rank('f', 'ASC NULLS FIRST')} AS fscore{suffix}, "
            f"{rank('m', 'ASC NULLS FIRST')} AS mscore{suffix}")


def _mixed(suffix: str = "") -> str:
    r, f, m = (f"{c}score{suffix}" for c in "rfm")
    return f"""0.3 * {r} + 0.3 * {f} + 0.4 * {m} AS rfm_score{suffix},
       CASE WHEN {r} > 0 AND {f} > 0 AND {m} > 0 THEN 3 / (1 / {r} + 1 / {f} + 1 / {m})
            ELSE 0 END AS rfm_score2{suffix}"""


def _round(*columns: str) -> str:
    return ", ".join(f"ROUND({c}, 6) AS {c}" for c in columns)


BY_CASE = f"PARTITION BY {CASE} "

STEPS = {
    "receipts": _receipt_select("", ""),
    "pos": _receipt_select("CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey END AS uid,",
                           "JOIN orders ON l_orderkey = o_orderkey"),
    "items": """
SELECT DISTINCT p_partkey % 5 AS jan, 'item ' || CAST(p_partkey % 5 AS VARCHAR) AS name,
       CAST(60 + 5 * (p_partkey % 5) AS DOUBLE) AS oprice,
       CASE WHEN p_partkey % 5 < 3 THEN 20 ELSE 30 END AS max_dprice,
       CAST(250 + 300 * (p_partkey % 5) AS DOUBLE) AS det_val, 'A' AS series FROM part""",
    "price_rows": """
SELECT salesday, store_cd, lv4_nm, lv5_nm, jan, salescnt, salesamount,
       ROUND(salesamount / salescnt, 2) AS price
FROM receipts WHERE salesamount > 0 AND salescnt > 0""",
    "day_prices": """
SELECT store_cd, jan, salesday, price, COUNT(*) AS pos FROM price_rows GROUP BY ALL""",
    "periods": _runs("day_prices"),
    "long_runs": "SELECT * FROM periods WHERE plen >= 75",
    "up": _up("long_runs"),
    "zero": _zero('CAST("end" AS TIMESTAMP)'),
    "categories": "SELECT DISTINCT store_cd, jan, lv4_nm, lv5_nm FROM price_rows",
    "cases": f"""
SELECT {CASE} FROM up LEFT JOIN categories USING (store_cd, jan)""",
    "zero_cases": f"""
SELECT {CASE} FROM zero LEFT JOIN categories USING (store_cd, jan)""",
    "clipped": """
SELECT salesday, store_cd, lv4_nm, lv5_nm, uid, jan, FLOOR(salesamount / salescnt) AS price,
       LEAST(salescnt, 6) AS salescnt,
       FLOOR(salesamount / salescnt) * LEAST(salescnt, 6) AS salesamount
FROM pos WHERE salesamount > 0 AND uid IS NOT NULL""",
    "days": """
SELECT store_cd, lv4_nm, lv5_nm, jan, uid, salesday, SUM(salesamount) AS salesamount,
       SUM(salescnt) AS salescnt
FROM clipped GROUP BY ALL""",
    "base": f"""
SELECT c.*, d.uid, SUM(d.salesamount) AS sample_amt_jan
FROM cases c JOIN clipped d ON {_same('c', 'd', ITEM)}
     AND d.salesday BETWEEN c.astart - INTERVAL 28 DAY AND c.astart - INTERVAL 1 DAY
GROUP BY ALL""",
    # sales between 63 days before the first change and the last change
    "near_days": """
SELECT * FROM days
WHERE salesday BETWEEN (SELECT MIN(astart) FROM base) - INTERVAL 63 DAY
                   AND (SELECT MAX(astart) FROM base)
  AND store_cd IN (SELECT store_cd FROM base)""",
    "spent_store": _spent("store", "store_cd"),
    "spent_lv5": _spent("lv5", "store_cd, lv4_nm, lv5_nm"),
    "spent_jan": _spent("jan", ITEM),
    "rfm_case_raw": f"""
SELECT b.*, CAST(DATE_DIFF('day', last_day, b.astart) AS INTEGER) AS r, f, m
FROM base b LEFT JOIN spent_store USING ({CASE}, uid)""",
    "rfm_global_raw": """
SELECT b.*, CAST(DATE_DIFF('day', last_day, b.astart) AS INTEGER) AS r, f, m
FROM base b LEFT JOIN (SELECT uid, MAX(salesday) AS last_day, COUNT(DISTINCT salesday) AS f,
                              SUM(salesamount) AS m FROM near_days GROUP BY uid) USING (uid)""",
    "rfm_case": f"SELECT *, {_scores('percent', BY_CASE)} FROM rfm_case_raw",
    "rfm_share": f"SELECT *, {_scores('share', BY_CASE)} FROM rfm_case_raw",
    "rfm_global": f"SELECT *, {_scores('percent', '')} FROM rfm_global_raw",
    "levels_raw": f"""
SELECT b.*, j.f AS f_jan, j.m AS m_jan, l.f AS f_lv5, l.m AS m_lv5,
       CAST(DATE_DIFF('day', j.last_day, b.astart) - 1 AS INTEGER) AS r_jan,
       CAST(DATE_DIFF('day', l.last_day, b.astart) - 1 AS INTEGER) AS r_lv5
FROM base b LEFT JOIN spent_jan j USING ({CASE}, uid) LEFT JOIN spent_lv5 l USING ({CASE}, uid)""",
    "levels": f"""
SELECT *, {_scores('percent', BY_CASE, '_jan')}, {_scores('percent', BY_CASE, '_lv5')}
FROM levels_raw""",
    "loyal": """
SELECT *, CASE WHEN m_lv5 <> 0 THEN m_jan / m_lv5 ELSE 0 END AS jan_loy_m,
       CASE WHEN f_lv5 <> 0 THEN f_jan / CAST(f_lv5 AS DOUBLE) ELSE 0 END AS jan_loy_f
FROM levels_raw""",
    "loyal_global": """
SELECT *, CASE WHEN m_lv5 <> 0 THEN m_jan / m_lv5 ELSE 0 END AS jan_loy_m,
       CASE WHEN f_lv5 <> 0 THEN f_jan / CAST(f_lv5 AS DOUBLE) ELSE 0 END AS jan_loy_f
FROM base
LEFT JOIN (SELECT uid, lv5_nm, SUM(salesamount) AS m_lv5, COUNT(DISTINCT salesday) AS f_lv5
           FROM near_days GROUP BY ALL) USING (uid, lv5_nm)
LEFT JOIN (SELECT uid, jan, SUM(salesamount) AS m_jan, COUNT(DISTINCT salesday) AS f_jan
           FROM near_days GROUP BY ALL) USING (uid, jan)""",
    "sized": """
SELECT d.*, det_val * salescnt AS volume,
       CASE WHEN lv5_nm <> 'milk' THEN lv5_nm WHEN det_val > 700 AND det_val < 1200
            THEN lv5_nm || '_L' ELSE lv5_nm || '_S' END AS plv5_nm
FROM days d JOIN items USING (jan)""",
    "sized_base": """
SELECT b.*, CASE WHEN lv5_nm <> 'milk' THEN lv5_nm WHEN det_val > 700 AND det_val < 1200
                 THEN lv5_nm || '_L' ELSE lv5_nm || '_S' END AS plv5_nm
FROM base b LEFT JOIN items USING (jan)""",
    "unit_prices": f"""
SELECT b.*,
       (SELECT SUM(s.salesamount) / SUM(s.volume) FROM sized s WHERE {_same('s', 'b', ITEM)}
        AND s.salesday BETWEEN b.astart - INTERVAL 63 DAY AND b.astart - INTERVAL 1 DAY) AS unitp_item,
       (SELECT SUM(s.salesamount) / SUM(s.volume) FROM sized s
        WHERE {_same('s', 'b', 'store_cd, lv4_nm, lv5_nm, plv5_nm')}
        AND s.salesday BETWEEN b.astart - INTERVAL 63 DAY AND b.astart - INTERVAL 1 DAY) AS unitp_cate
FROM (SELECT DISTINCT {CASE}, plv5_nm FROM sized_base) b""",
    "member_prices": f"""
SELECT b.{', b.'.join(CASE.split(', '))}, b.uid, SUM(s.salesamount) / SUM(s.volume) AS unitp_uid,
       COUNT(DISTINCT s.salesday) AS ndays
FROM sized_base b JOIN sized s ON {_same('s', 'b', 'store_cd, lv4_nm, lv5_nm, plv5_nm, uid')}
     AND s.salesday BETWEEN b.astart - INTERVAL 63 DAY AND b.astart - INTERVAL 1 DAY
GROUP BY ALL""",
    "sensitive": f"""
SELECT b.*, unitp_item, unitp_cate, unitp_uid, ndays,
       CASE WHEN unitp_cate <> 0 THEN (unitp_item - unitp_cate) / unitp_cate ELSE 0 END AS pscore_item,
       CASE WHEN unitp_cate <> 0 THEN (unitp_uid - unitp_cate) / unitp_cate
            * LEAST(CASE WHEN ndays IS NOT NULL THEN ndays / 6.0 END, 1.0)
            ELSE 0 END AS pscore_ucate
FROM sized_base b LEFT JOIN unit_prices u USING ({CASE}) LEFT JOIN member_prices p USING ({CASE}, uid)""",
    "sized_global": """
SELECT d.*, det_val * salescnt AS volume, plv5_nm FROM near_days d
JOIN (SELECT DISTINCT jan, det_val, plv5_nm FROM sized_base JOIN items USING (jan)) USING (jan)""",
    "sensitive_global": """
SELECT b.*, unitp_item, unitp_cate, unitp_uid, ndays,
       CASE WHEN unitp_cate <> 0 THEN (unitp_item - unitp_cate) / unitp_cate ELSE 0 END AS pscore_item,
       CASE WHEN unitp_cate <> 0 THEN (unitp_uid - unitp_cate) / unitp_cate
            * LEAST(CASE WHEN ndays IS NOT NULL THEN ndays / 6.0 END, 1.0)
            ELSE 0 END AS pscore_ucate
FROM sized_base b
LEFT JOIN (SELECT jan, SUM(salesamount) / SUM(volume) AS unitp_item FROM sized_global GROUP BY jan)
     USING (jan)
LEFT JOIN (SELECT plv5_nm, SUM(salesamount) / SUM(volume) AS unitp_cate FROM sized_global
           GROUP BY plv5_nm) USING (plv5_nm)
LEFT JOIN (SELECT uid, plv5_nm, SUM(salesamount) / SUM(volume) AS unitp_uid,
                  COUNT(DISTINCT salesday) AS ndays FROM sized_global GROUP BY ALL)
     USING (uid, plv5_nm)""",
    "spent_items": f"""
SELECT c.{', c.'.join(CASE.split(', '))}, d.uid, d.jan AS sold, SUM(d.salesamount) AS amount
FROM (SELECT DISTINCT {CASE} FROM base) c
JOIN days d ON {_same('c', 'd', 'store_cd, lv4_nm, lv5_nm')}
     AND d.salesday BETWEEN c.astart - INTERVAL 63 DAY AND c.astart - INTERVAL 1 DAY
GROUP BY ALL""",
    "pairs": f"""
SELECT {CASE}, uid, t.amount AS tamt, o.sold AS competitor,
       (0.5 - ABS(o.amount / (o.amount + t.amount) - 0.5)) * 2 AS kani
FROM (SELECT * FROM spent_items WHERE sold = jan) t
JOIN (SELECT * FROM spent_items WHERE sold <> jan) o USING ({CASE}, uid)""",
    "kani_case": f"""
SELECT {CASE}, SUM(score) / 5.0 AS kani_score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {CASE} ORDER BY score DESC, competitor) AS place
      FROM (SELECT {CASE}, competitor, SUM(kani * tamt) / ANY_VALUE(wall) AS score
            FROM pairs JOIN (SELECT {CASE}, SUM(amount) AS wall FROM spent_items WHERE sold = jan
                             GROUP BY ALL) USING ({CASE})
            GROUP BY {CASE}, competitor))
WHERE place <= 5 GROUP BY {CASE}""",
    "kani_exponential": f"""
SELECT {CASE}, SUM(score * POW(2, -place)) / (1 - POW(2, -COUNT(*))) AS kani_score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {CASE} ORDER BY score DESC, competitor) AS place
      FROM (SELECT {CASE}, competitor, SUM(kani) AS score FROM pairs GROUP BY ALL))
WHERE place <= 5 GROUP BY {CASE}""",
    "baskets": """
SELECT uid, lv5_nm, jan, SUM(salesamount) AS amount FROM near_days GROUP BY ALL""",
    "kani_global": """
SELECT jan, SUM(score) / 5.0 AS kani_score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY jan ORDER BY score DESC, competitor) AS place
      FROM (SELECT t.jan, o.jan AS competitor,
                   SUM((0.5 - ABS(o.amount / (o.amount + t.amount) - 0.5)) * 2 * t.amount)
                   / ANY_VALUE(wall) AS score
            FROM baskets t JOIN baskets o ON t.uid = o.uid AND t.lv5_nm = o.lv5_nm AND t.jan <> o.jan
            JOIN (SELECT jan, SUM(amount) AS wall FROM baskets GROUP BY jan) w ON w.jan = t.jan
            GROUP BY ALL))
WHERE place <= 5 GROUP BY jan""",
    "fact": """
SELECT CAST(l_shipdate AS DATE) AS SALES_DATE, l_suppkey AS STORE_CODE, o_custkey AS MEMBER_CODE,
       LPAD(CAST(l_partkey AS VARCHAR), 20, '0') AS JAN_CODE, l_quantity AS SALES_NUMBER,
       l_extendedprice - 5000 AS SALES_AMOUNT, l_partkey % 20 AS CATEGORY_KEY,
       l_partkey AS PRODUCT_CODE, 20 + o_custkey % 60 AS AGE, o_custkey % 2 AS GENDER_FLG
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "category": """
SELECT DISTINCT p_partkey % 20 AS CATEGORY_KEY,
       'area ' || CAST(p_partkey % 20 % 2 AS VARCHAR) AS CATEGORY1_NAME,
       'group ' || CAST(p_partkey % 20 % 4 AS VARCHAR) AS CATEGORY2_NAME,
       'class ' || CAST(p_partkey % 20 AS VARCHAR) AS CATEGORY3_NAME
FROM part WHERE p_partkey % 20 <> 19""",
    "product": """
SELECT p_partkey AS PRODUCT_CODE, p_name AS PRODUCT_NAME FROM part WHERE p_partkey % 50 <> 7""",
    "scanned": """
SELECT SALES_DATE AS salesday, CAST(STORE_CODE AS INTEGER) AS store_cd, MEMBER_CODE AS uid,
       CAST(JAN_CODE AS BIGINT) AS jan, CAST(SALES_NUMBER AS DOUBLE) AS salescnt,
       CAST(SALES_AMOUNT AS DOUBLE) AS salesamount, PRODUCT_NAME AS name,
       CATEGORY1_NAME AS lv3_nm, CATEGORY2_NAME AS lv4_nm, CATEGORY3_NAME AS lv5_nm, AGE, GENDER_FLG
FROM fact JOIN category USING (CATEGORY_KEY) JOIN product USING (PRODUCT_CODE)
WHERE SALES_AMOUNT > 0""",
    "predictions": """
SELECT store_cd, lv4_nm, lv5_nm, jan, uid, sample_amt_jan, CAST(150 + 5 * jan AS DOUBLE) AS pprice,
       CAST(dp AS INTEGER) AS dp,
       0.80::DOUBLE - 0.01::DOUBLE * (uid % 7)
         + (CASE WHEN uid % 11 = 0 THEN 0.001::DOUBLE ELSE -0.001::DOUBLE END) * dp AS prob_jan,
       0.95::DOUBLE - 0.01::DOUBLE * (uid % 7)
         - 0.00025::DOUBLE * ((2 * jan + store_cd) % 5) * dp * dp AS prob_lv5
FROM (SELECT store_cd, lv4_nm, lv5_nm, jan, uid, SUM(salesamount) AS sample_amt_jan FROM pos
      WHERE uid IS NOT NULL AND salesamount > 0 GROUP BY ALL)
CROSS JOIN (VALUES (0), (10), (20), (30)) g(dp)""",
    # a running minimum of p + 0.008 * step, brought back to the step, is the stepwise lowered value
    "lowered_lv5": """
SELECT *, GREATEST(0, MIN(prob_lv5 + 0.0008 * dp) OVER (PARTITION BY store_cd, jan, uid ORDER BY dp)
                      - 0.0008 * dp) AS low_lv5 FROM predictions""",
    "lowered": """
SELECT * EXCLUDE (prob_jan, prob_lv5, low_lv5), low_lv5 AS prob_lv5,
       GREATEST(0, MIN(LEAST(prob_jan, low_lv5) + 0.0028 * dp)
                   OVER (PARTITION BY store_cd, jan, uid ORDER BY dp) - 0.0028 * dp) AS prob_jan
FROM lowered_lv5""",
    "simulated": """
SELECT p.store_cd, p.lv4_nm, p.lv5_nm, p.jan, i.name, p.uid, p.pprice, p.pprice + p.dp AS rec_price,
       p.pprice + max_dprice AS max_price, p.dp, cnt * (p.pprice - oprice) AS prof_pre,
       p.sample_amt_jan,
       (p.prob_jan * p.dp - (1 - p.prob_lv5) * (p.pprice - oprice)) * cnt
         + (1 - z.prob_lv5) * (p.pprice - oprice) * cnt AS prof_ch,
       (p.prob_jan * p.dp - (1 - p.prob_lv5) * p.pprice) * cnt
         + (1 - z.prob_lv5) * p.pprice * cnt AS amt_ch,
       p.prob_lv5 - z.prob_lv5 AS prob5_ch
FROM (SELECT *, CAST(TRUNC(sample_amt_jan / pprice) AS BIGINT) AS cnt FROM predictions WHERE dp > 0) p
JOIN predictions z ON z.store_cd = p.store_cd AND z.jan = p.jan AND z.uid = p.uid AND z.dp = 0
LEFT JOIN items i ON i.jan = p.jan""",
    "valid": """
SELECT *, prof_ch / NULLIF(prof_pre, 0) AS prof_chr, amt_ch / NULLIF(sample_amt_jan, 0) AS amt_chr
FROM (SELECT store_cd, lv4_nm, lv5_nm, jan, name, pprice, rec_price, max_price,
             SUM(prof_ch) AS prof_ch, SUM(amt_ch) AS amt_ch, AVG(prob5_ch) AS prob5_ch,
             SUM(prof_pre) AS prof_pre, SUM(sample_amt_jan) AS sample_amt_jan
      FROM simulated GROUP BY ALL)
WHERE rec_price <= max_price AND prof_ch > 0 AND amt_ch / NULLIF(sample_amt_jan, 0) >= -0.9
  AND prob5_ch >= -0.9""",
    "best": """
SELECT * FROM valid
QUALIFY ROW_NUMBER() OVER (PARTITION BY store_cd, jan ORDER BY prof_ch DESC, rec_price) = 1""",
    "allowed": """
SELECT store_cd, series, rec_price
FROM (SELECT DISTINCT store_cd, series, rec_price FROM best JOIN items USING (jan))
QUALIFY ROW_NUMBER() OVER (PARTITION BY store_cd, series ORDER BY rec_price) <= 2""",
    "capped": """
SELECT v.* FROM best b JOIN items i ON i.jan = b.jan
JOIN valid v ON v.store_cd = b.store_cd AND v.jan = b.jan AND v.rec_price <= b.rec_price
JOIN allowed a ON a.store_cd = v.store_cd AND a.series = i.series AND a.rec_price = v.rec_price
WHERE v.rec_price = b.rec_price OR b.rec_price NOT IN
      (SELECT rec_price FROM allowed x WHERE x.store_cd = b.store_cd AND x.series = i.series)
QUALIFY ROW_NUMBER() OVER (PARTITION BY v.store_cd, v.jan ORDER BY v.rec_price DESC) = 1""",
}


def _sql(select: str) -> str:
    """The select with every step that it or another needed step names, in order of definition."""
    needed, queue = set(), [select]
    while queue:
        text = queue.pop()
        for name in STEPS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                queue.append(STEPS[name])
    steps = ",\n".join(f"{name} AS ({STEPS[name]})" for name in STEPS if name in needed)
    return f"WITH {steps}\n{select}" if steps else select


SCANNED = "salesday, store_cd, uid, jan, salescnt, salesamount, name, lv3_nm, lv4_nm, lv5_nm"
KEY = f"{CASE}, uid"


def _rfm(step: str) -> str:
    return f"SELECT {KEY}, r, f, m, rscore, fscore, mscore, {_mixed()} FROM {step}"


def _loyalty(step: str) -> str:
    return (f"SELECT {KEY}, f_lv5, f_jan, m_lv5, m_jan, jan_loy_m, jan_loy_f, "
            f"(jan_loy_m + jan_loy_f) / 2 AS jan_loy FROM {step}")


def _pscore(step: str) -> str:
    return (f"SELECT {KEY}, plv5_nm, ndays, unitp_item, unitp_cate, unitp_uid, pscore_item, "
            f"pscore_ucate, ABS(pscore_ucate - 0.5) AS pscore_ucate_dis050 FROM {step}")


def _kani(step: str, keys: str) -> str:
    return (f"SELECT {KEY}, ROUND(COALESCE(kani_score, 0), 9) AS kani_score, "
            f"ROUND(ABS(COALESCE(kani_score, 0) - 0.25), 9) AS kani_score_dis025 "
            f"FROM base LEFT JOIN {step} USING ({keys})")


def _features(rfm: str, loyal: str, sensitive: str, kani: str, keys: str) -> str:
    zero = lambda *cs: ", ".join(f"COALESCE({c}, 0) AS {c}" for c in cs)
    return f"""
SELECT {KEY}, aprice - pprice AS dprice, (aprice - pprice) / pprice AS dprice_pct,
       {zero('rscore', 'fscore', 'mscore')}, {_mixed()},
       {zero('jan_loy_m', 'jan_loy_f', 'm_lv5', 'f_lv5', 'unitp_cate', 'unitp_uid', 'pscore_item',
             'pscore_ucate')},
       COALESCE((jan_loy_m + jan_loy_f) / 2, 0) AS jan_loy,
       COALESCE(ABS(pscore_ucate - 0.5), 0) AS pscore_ucate_dis050,
       ROUND(COALESCE(kani_score, 0), 9) AS kani_score,
       ROUND(ABS(COALESCE(kani_score, 0) - 0.25), 9) AS kani_score_dis025
FROM {rfm}
JOIN (SELECT {KEY}, jan_loy_m, jan_loy_f, m_lv5, f_lv5 FROM {loyal}) USING ({KEY})
JOIN (SELECT {KEY}, unitp_cate, unitp_uid, pscore_item, pscore_ucate FROM {sensitive}) USING ({KEY})
LEFT JOIN {kani} USING ({keys})"""


ITEM_RESULT = ("store_cd, lv4_nm, lv5_nm, jan, name, pprice, rec_price, max_price, prof_pre, "
               "sample_amt_jan, " + _round("prof_ch", "amt_ch", "prob5_ch", "prof_chr", "amt_chr"))

QUERIES = {name: _sql(select) for name, select in {
    "pos_scan": f"SELECT {SCANNED} FROM scanned",
    "pos_scan_left": """
SELECT SALES_DATE AS salesday, CAST(STORE_CODE AS INTEGER) AS store_cd, MEMBER_CODE AS uid,
       CAST(JAN_CODE AS BIGINT) AS jan, CAST(SALES_NUMBER AS DOUBLE) AS salescnt,
       CAST(SALES_AMOUNT AS DOUBLE) AS salesamount, PRODUCT_NAME AS name,
       CATEGORY1_NAME AS lv3_nm, CATEGORY2_NAME AS lv4_nm, CATEGORY3_NAME AS lv5_nm
FROM fact LEFT JOIN category USING (CATEGORY_KEY) LEFT JOIN product USING (PRODUCT_CODE)
WHERE SALES_AMOUNT > 0""",
    "pos_filters": f"""
SELECT {SCANNED} FROM scanned WHERE salesday BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
AND store_cd IN (1, 2, 3, 5, 8) AND lv3_nm = 'area 1'""",
    "pos_scan_damaged": f"""
SELECT {SCANNED} FROM scanned WHERE jan % 11 <> 0 AND jan % 13 <> 0 AND jan % 17 <> 0""",
    "pos_scan_rejects": """
SELECT CASE WHEN PRODUCT_CODE % 11 = 0 THEN 'A' || JAN_CODE WHEN PRODUCT_CODE % 13 = 0
            THEN '98765432109876543210' ELSE JAN_CODE END AS JAN_CODE,
       CASE WHEN PRODUCT_CODE % 17 = 0 THEN 'north' ELSE CAST(STORE_CODE AS VARCHAR) END AS STORE_CODE,
       COUNT(*) AS lines
FROM fact WHERE PRODUCT_CODE % 11 = 0 OR PRODUCT_CODE % 13 = 0 OR PRODUCT_CODE % 17 = 0 GROUP BY ALL""",
    "pos_member_filter": f"SELECT {SCANNED} FROM scanned WHERE uid IN (7, 8, 10, 11)",
    "pos_names_filter": f"""
SELECT {SCANNED} FROM scanned WHERE lv4_nm = 'group 1' AND lv5_nm IN ('class 1', 'class 5')""",
    "item_master_rows": """
SELECT p_partkey AS jan, p_name AS name, CAST(80.5 AS DOUBLE) AS oprice,
       CAST(CASE p_partkey % 3 WHEN 0 THEN 50 WHEN 2 THEN 20 END AS DOUBLE) AS max_dprice
FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 10 <> 1 AND p_partkey % 5 <> 0""",
    "item_master_rejects": """
SELECT * FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'X' || p_partkey WHEN p_partkey % 10 = 1 THEN ' '
                           ELSE CAST(p_partkey AS VARCHAR) END AS jan, p_name AS name,
                      CASE WHEN p_partkey % 5 = 0 THEN '12,5' ELSE ' 80.5 ' END AS oprice,
                      CASE p_partkey % 3 WHEN 0 THEN '50.0' WHEN 1 THEN '' ELSE '20' END AS max_dprice,
                      CASE WHEN p_partkey % 7 = 0 THEN 'unreadable jan' WHEN p_partkey % 10 = 1 THEN 'no jan'
                           WHEN p_partkey % 5 = 0 THEN 'unreadable oprice' END AS reason FROM part)
WHERE reason IS NOT NULL""",
    "pack_master_rows": """
SELECT p_partkey AS jan, CAST(CASE WHEN p_partkey % 4 <> 0 THEN p_size * 50 END AS DOUBLE) AS det_val
FROM part WHERE p_partkey % 13 <> 0 AND (p_partkey % 4 = 0 OR p_partkey % 9 <> 0)""",
    "series_master_rows": """
SELECT p_partkey AS jan, CASE WHEN p_partkey % 6 <> 0 THEN p_brand END AS series FROM part WHERE p_partkey % 5 <> 0""",
    "sink_by_store": """
SELECT *, COUNT(*) OVER (PARTITION BY store_cd) AS rows, LPAD(CAST(store_cd AS VARCHAR), 4, '0') AS store
FROM (SELECT CAST(l_suppkey % 12 AS INTEGER) AS store_cd, l_partkey % 5 AS jan, SUM(l_quantity) AS units, COUNT(*) AS lines
      FROM lineitem WHERE l_suppkey % 12 < 6 OR l_returnflag = 'N' GROUP BY ALL)""",
    "sample_dump": "SELECT * FROM base",
    "item_result_ordered": """
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY store_cd ORDER BY lv4_nm, lv5_nm, rank) AS INTEGER) AS place
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY store_cd, lv4_nm, lv5_nm ORDER BY units DESC, jan) AS INTEGER) AS rank
      FROM (SELECT CAST(l_suppkey % 3 AS INTEGER) AS store_cd, 'group ' || (l_partkey % 4) AS lv4_nm,
                   'class ' || (l_partkey % 20) AS lv5_nm, l_partkey AS jan, SUM(l_quantity) AS units
            FROM lineitem GROUP BY ALL))""",
    "pos_item_filter": f"SELECT {SCANNED} FROM scanned WHERE jan IN (5, 11, 13)",
    "pos_demographic_filter": f"SELECT {SCANNED} FROM scanned WHERE AGE = 33 AND GENDER_FLG = 1",
    "pos_topk": f"""
SELECT {SCANNED} FROM scanned
ORDER BY salesday, store_cd, jan, uid, salescnt, salesamount LIMIT 100""",
    "predicate_builder": """
SELECT SALES_DATE, STORE_CODE, MEMBER_CODE, JAN_CODE FROM fact
WHERE SALES_DATE BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND STORE_CODE IN (1, 4, 9)
  AND GENDER_FLG = 1""",
    "store_list": "SELECT DISTINCT s_name AS STORE_NAME, s_suppkey AS STORE_CODE FROM supplier",
    "store_lookup": """
SELECT DISTINCT s_name AS STORE_NAME, s_suppkey AS STORE_CODE FROM supplier
WHERE s_name IN (SELECT s_name FROM supplier WHERE s_acctbal > 5000)""",
    "item_drop_anti": "SELECT jan, name, oprice, max_dprice FROM items WHERE jan <> 4",
    "flagged_rows": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "unit_price": "SELECT * FROM price_rows",
    "member_filter": """
SELECT uid, COUNT(*) AS n, SUM(salesamount) AS amount FROM pos
WHERE salesamount > 0 AND uid IS NOT NULL AND uid <> 1 GROUP BY uid""",
    "noise_clip": """
SELECT salesday, store_cd, uid, jan, price, salescnt, salesamount FROM clipped""",
    "noise_clip_exact": """
SELECT l_orderkey, l_linenumber, LEAST(l_quantity, 6) AS salescnt,
       l_extendedprice / l_quantity * LEAST(l_quantity, 6) AS salesamount,
       l_extendedprice / l_quantity AS price FROM lineitem""",
    "member_days": "SELECT * FROM days",
    "null_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) AS total_rows, COUNT(*) - COUNT({c}) AS null_count, "
        f"(COUNT(*) - COUNT({c})) / CAST(COUNT(*) AS DOUBLE) AS null_ratio FROM pos"
        for c in SCANNED.split(", ")),
    "date_offset": """
SELECT o_orderkey, STRFTIME(o_orderdate, '%Y-%m-%d') AS day,
       STRFTIME(o_orderdate - INTERVAL 28 DAY, '%Y-%m-%d') AS shifted FROM orders""",
    "epoch_date": """
SELECT o_orderkey, STRFTIME(MAKE_TIMESTAMP(o_orderkey * 86399 * 1000000), '%Y-%m-%d') AS day,
       o_orderstatus AS passed_through FROM orders""",
    "day_price": "SELECT * FROM day_prices",
    "price_periods": "SELECT * FROM periods",
    "price_periods_many": _runs("""
(SELECT CAST(l_suppkey % 2 AS INTEGER) AS store_cd, l_partkey % 5 AS jan,
        CAST(l_shipdate AS DATE) AS salesday,
        ROUND(l_quantity * (1 + FLOOR(l_extendedprice / 30000)) / l_quantity, 2) AS price,
        COUNT(*) AS pos FROM lineitem GROUP BY ALL)"""),
    "cases_up": "SELECT * FROM up",
    "cases_up_lead_first": _up("periods"),
    "cases_zero": "SELECT * FROM zero",
    "cases_zero_single": _zero('CAST("start" + INTERVAL 82 DAY AS TIMESTAMP)'),
    "case_master_up": "SELECT * FROM cases",
    "case_master_zero": "SELECT * FROM zero_cases",
    "case_master_both": "SELECT * FROM cases UNION ALL SELECT * FROM zero_cases",
    "price_features": f"""
SELECT {CASE}, aprice - pprice AS dprice, (aprice - pprice) / pprice AS dprice_pct
FROM cases""",
    "target_cases": f"""
SELECT DISTINCT store_cd, lv4_nm, lv5_nm, jan, price AS pprice, price + 10 AS aprice,
       DATE '{UPDAY}' AS astart
FROM (SELECT *, MIN(price) OVER (PARTITION BY store_cd, jan) AS low,
             MAX(price) OVER (PARTITION BY store_cd, jan) AS high
      FROM price_rows WHERE salesday BETWEEN DATE '{UPDAY}' - INTERVAL 75 DAY
                                         AND DATE '{UPDAY}' - INTERVAL 1 DAY
                        AND jan IN (SELECT jan FROM items WHERE jan <> 3))
WHERE low = high""",
    "sample_customers": "SELECT * FROM base",
    "sample_customers_zero": f"""
SELECT c.*, d.uid, SUM(d.salesamount) AS sample_amt_jan
FROM zero_cases c JOIN clipped d ON {_same('c', 'd', ITEM)}
     AND d.salesday BETWEEN c.astart - INTERVAL 28 DAY AND c.astart - INTERVAL 1 DAY
GROUP BY ALL""",
    "labels_case": _label("case"),
    "labels_item": _label("item"),
    "label_ints": f"""
SELECT {CASE}, uid, CAST(label_jan AS INTEGER) AS label_jan, CAST(label_lv5 AS INTEGER) AS label_lv5
FROM ({_label("case")})""",
    "pack_size_category": """
SELECT jan, lv5_nm, det_val, CASE WHEN lv5_nm <> 'milk' THEN lv5_nm
       WHEN det_val > 700 AND det_val < 1200 THEN 'milk_L' ELSE 'milk_S' END AS plv5_nm
FROM (SELECT DISTINCT jan, lv5_nm FROM receipts) LEFT JOIN (SELECT jan, det_val FROM items) USING (jan)""",
    "pack_size_category_all": """
SELECT jan, lv5_nm, det_val, CASE WHEN lv5_nm = 'milk' AND det_val > 700 AND det_val < 1200
       THEN 'milk_L' ELSE lv5_nm || '_S' END AS plv5_nm
FROM (SELECT DISTINCT jan, lv5_nm FROM receipts) LEFT JOIN (SELECT jan, det_val FROM items) USING (jan)""",
    "rfm_global": _rfm("rfm_global"),
    "rfm_case": _rfm("rfm_case"),
    "rfm_rank_norm": _rfm("rfm_share"),
    "rfm_levels": f"""
SELECT {KEY}, r_jan, f_jan, r_lv5, f_lv5, {_mixed('_jan')}, {_mixed('_lv5')},
       m_jan, rscore_jan, fscore_jan, mscore_jan, m_lv5, rscore_lv5, fscore_lv5, mscore_lv5
FROM levels""",
    "loyalty": _loyalty("loyal"),
    "loyalty_clustered": _loyalty("loyal"),
    "loyalty_global": _loyalty("loyal_global"),
    "pscore": _pscore("sensitive"),
    "pscore_global": _pscore("sensitive_global"),
    "kani_mean5": _kani("kani_case", CASE),
    "kani_global": _kani("kani_global", "jan"),
    "kani_exp": _kani("kani_exponential", CASE),
    "kani_top_sales": """
SELECT jan, ROUND(AVG(amount), 6) AS kani_score
FROM (SELECT jan, amount, RANK() OVER (PARTITION BY uid ORDER BY amount DESC) AS place
      FROM (SELECT uid, jan, salesamount / salescnt * LEAST(salescnt, 6) AS amount FROM pos
            WHERE salesamount > 0 AND uid IS NOT NULL))
WHERE place <= 5 GROUP BY jan""",
    "features_all": _features("rfm_case", "loyal", "sensitive", "kani_case", CASE),
    "features_all_global": _features("rfm_global", "loyal_global", "sensitive_global", "kani_global",
                                     "jan"),
    "oversample": """
WITH rows AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                     10.0 * FLOOR(SQRT(l_quantity)) AS dprice FROM lineitem),
sizes AS (SELECT dprice, COUNT(*) AS n FROM rows WHERE dprice IN (10, 30, 50, 70) GROUP BY dprice),
factors AS (SELECT dprice, n, LEAST((SELECT MAX(n) FROM sizes) / CAST(n AS DOUBLE), 3.0) - 1 AS factor
            FROM sizes),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dprice ORDER BY
               MD5(CONCAT_WS('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)))
               AS place FROM rows)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(dprice AS DOUBLE) AS dprice,
       CAST(SUM(CASE WHEN factor IS NULL THEN 1 ELSE 1 + FLOOR(factor)
                + CASE WHEN place <= FLOOR((factor - FLOOR(factor)) * n) THEN 1 ELSE 0 END END)
            AS BIGINT) AS copies
FROM placed LEFT JOIN factors USING (dprice) GROUP BY ALL""",
    "median_fill_exact": """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber <> 3 THEN l_quantity
            ELSE (SELECT QUANTILE_DISC(l_quantity, 0.5) FROM lineitem WHERE l_linenumber <> 3) END AS quantity,
       CASE WHEN l_linenumber <> 5 THEN l_extendedprice
            ELSE (SELECT QUANTILE_DISC(l_extendedprice, 0.5) FROM lineitem WHERE l_linenumber <> 5) END AS price
FROM lineitem""",
    "price_grid": f"""
SELECT {CASE.replace('aprice', 'aprice + dp AS aprice')}, CAST(dp AS INTEGER) AS dp
FROM cases CROSS JOIN (VALUES (0), (10), (20), (30)) g(dp)""",
    "prob_pivot": "SELECT store_cd, lv4_nm, lv5_nm, jan, uid, sample_amt_jan, pprice, " + ", ".join(
        f"MAX(CASE WHEN dp = {dp} THEN {p} END) AS {p}_{dp}"
        for dp in (0, 10, 20, 30) for p in ("prob_jan", "prob_lv5"))
        + " FROM predictions GROUP BY ALL",
    "clamp_prob": """
SELECT store_cd, lv4_nm, lv5_nm, jan, uid, sample_amt_jan, pprice, dp,
       LEAST(1, GREATEST(0, 3 * prob_jan - 1.5)) AS prob_jan,
       LEAST(1, GREATEST(0, 3 * prob_lv5 - 1.5)) AS prob_lv5 FROM predictions""",
    "monotone_prob": f"""
SELECT store_cd, lv4_nm, lv5_nm, jan, uid, sample_amt_jan, pprice, dp,
       {_round('prob_jan', 'prob_lv5')} FROM lowered""",
    "simulate_long": f"""
SELECT store_cd, lv4_nm, lv5_nm, jan, name, uid, pprice, rec_price, max_price, dp,
       prof_ch, amt_ch, prob5_ch, prof_pre, sample_amt_jan,
       COALESCE(prof_ch / NULLIF(prof_pre, 0), 0) AS prof_chr,
       COALESCE(amt_ch / NULLIF(sample_amt_jan, 0), 0) AS amt_chr FROM simulated""",
    "simulate_repeated_items": f"""
SELECT store_cd, lv4_nm, lv5_nm, jan, name, uid, pprice, rec_price, max_price, dp,
       prof_ch, amt_ch, prob5_ch, prof_pre, sample_amt_jan,
       COALESCE(prof_ch / NULLIF(prof_pre, 0), 0) AS prof_chr,
       COALESCE(amt_ch / NULLIF(sample_amt_jan, 0), 0) AS amt_chr FROM simulated""",
    "best_item_price": f"""
SELECT {ITEM_RESULT}, CAST(RANK() OVER (PARTITION BY store_cd, lv4_nm, lv5_nm
                                        ORDER BY prof_ch DESC) AS INTEGER) AS rank FROM best""",
    "item_rank_avg": """
SELECT store_cd, jan, rec_price, place + (rows_so_far - 1) / 2.0 AS rank_running,
       place + (ties - 1) / 2.0 AS rank
FROM (SELECT *, RANK() OVER (PARTITION BY store_cd, lv4_nm, lv5_nm ORDER BY prof_ch DESC) AS place,
             COUNT(prof_ch) OVER (PARTITION BY store_cd, lv4_nm, lv5_nm ORDER BY prof_ch DESC)
               AS rows_so_far,
             COUNT(*) OVER (PARTITION BY store_cd, lv4_nm, lv5_nm, prof_ch) AS ties FROM best)""",
    "series_price_cap": f"""
SELECT {ITEM_RESULT}, CAST(RANK() OVER (PARTITION BY store_cd, lv4_nm, lv5_nm
                                        ORDER BY prof_ch DESC) AS INTEGER) AS rank FROM capped""",
    "best_customer_price": """
SELECT store_cd, lv4_nm, lv5_nm, jan, name, pprice, rec_price, uid AS id, id_rec_price,
       GREATEST(rec_price - id_rec_price, 0) AS disc_price
FROM (SELECT s.* EXCLUDE (rec_price), b.rec_price,
             CASE WHEN s.prof_ch < 0 THEN s.pprice ELSE s.rec_price END AS id_rec_price
      FROM (SELECT * FROM simulated QUALIFY ROW_NUMBER() OVER (
                PARTITION BY store_cd, jan, uid ORDER BY prof_ch DESC, rec_price) = 1) s
      JOIN best b ON b.store_cd = s.store_cd AND b.jan = s.jan)""",
}.items()}

QUERIES["model_eval_fixed"] = """
WITH r AS (SELECT CASE WHEN l_quantity + l_partkey % 10 < 40 THEN 1 ELSE 0 END AS label,
                  1 - FLOOR(l_quantity) / 64 AS prob FROM lineitem
           WHERE CAST('0x' || SUBSTR(MD5(l_orderkey || '|' || l_linenumber), 1, 8) AS BIGINT) % 5 = 0)
SELECT (SELECT AVG(CASE WHEN p.prob > n.prob THEN 1.0::DOUBLE WHEN p.prob = n.prob THEN 0.5 ELSE 0 END)
        FROM r p JOIN r n ON p.label = 1 AND n.label = 0) AS auc,
       (SELECT AVG(CAST(label AS DOUBLE)) FROM r WHERE prob >= 0.6) AS precision,
       (SELECT AVG(CASE WHEN prob >= 0.6 THEN 1.0::DOUBLE ELSE 0 END) FROM r WHERE label = 1) AS recall,
       (SELECT COUNT(*) FROM r) AS rows"""


def _many(name: str) -> str:
    """The same query over 24 items in three categories."""
    sql = QUERIES[name]
    for old, new in (("l_partkey % 5", "l_partkey % 24"), ("'lv4' AS lv4_nm", "'group ' || (l_partkey % 24) // 16 AS lv4_nm"),
                     ("CASE WHEN l_partkey % 24 < 3 THEN 'milk' ELSE 'tea' END AS lv5_nm",
                      "'class ' || (l_partkey % 24) // 8 AS lv5_nm")):
        assert old in sql
        sql = sql.replace(old, new)
    return sql


QUERIES |= {f"{name}_many": _many(name) for name in ("kani_mean5", "kani_exp", "kani_global")}

# 24 items of which each two sell alike
PAIRED = {
    STEPS["predictions"]: """
SELECT store_cd, 'group ' || (half % 2) AS lv4_nm, 'class ' || (half % 4) AS lv5_nm,
       half + shift AS jan, uid, sample_amt_jan, CAST(150 + 5 * half AS DOUBLE) AS pprice,
       CAST(dp AS INTEGER) AS dp, 0.80::DOUBLE - 0.01::DOUBLE * (uid % 7) - 0.001::DOUBLE * dp AS prob_jan,
       0.95::DOUBLE - 0.01::DOUBLE * (uid % 7)
         - 0.00025::DOUBLE * ((2 * half + store_cd) % 5) * dp * dp AS prob_lv5
FROM (SELECT store_cd, jan AS half, uid, SUM(salesamount) AS sample_amt_jan FROM pos
      WHERE uid IS NOT NULL AND salesamount > 0 GROUP BY ALL)
CROSS JOIN (VALUES (0), (10), (20), (30)) g(dp) CROSS JOIN (VALUES (0), (12)) s(shift)""",
    STEPS["items"]: """
SELECT DISTINCT p_partkey % 24 AS jan, 'item ' || (p_partkey % 12) AS name,
       CAST(60 + 5 * (p_partkey % 12) AS DOUBLE) AS oprice,
       CAST(CASE WHEN p_partkey % 12 % 3 = 0 THEN 20 ELSE 30 END AS DOUBLE) AS max_dprice,
       CASE WHEN p_partkey % 24 % 7 <> 0 THEN CAST(250 + 50 * (p_partkey % 24) AS DOUBLE) END AS det_val,
       CASE WHEN p_partkey % 24 % 5 <> 0 THEN 'S' || (p_partkey % 24 % 2) END AS series FROM part""",
    "l_partkey % 5": "l_partkey % 12",
}


def _paired(sql: str) -> str:
    for old, new in PAIRED.items():
        sql = sql.replace(old, new)
    return sql


QUERIES["item_rank_ties"] = _paired(_sql("""
SELECT store_cd, jan, rec_price, place + (rows_so_far - 1) / 2.0 AS rank_running, CAST(place AS INTEGER) AS rank_lowest,
       place + (ties - 1) / 2.0 AS rank
FROM (SELECT *, RANK() OVER (PARTITION BY store_cd, lv4_nm, lv5_nm ORDER BY prof_ch DESC) AS place,
             COUNT(prof_ch) OVER (PARTITION BY store_cd, lv4_nm, lv5_nm ORDER BY prof_ch DESC) AS rows_so_far,
             COUNT(*) OVER (PARTITION BY store_cd, lv4_nm, lv5_nm, prof_ch) AS ties
      FROM (SELECT * REPLACE (ROUND(prof_ch, 4) AS prof_ch) FROM valid
            QUALIFY ROW_NUMBER() OVER (PARTITION BY store_cd, jan
                                       ORDER BY ROUND(prof_ch, 4) DESC, rec_price) = 1))"""))
QUERIES["series_price_cap_many"] = _paired(_sql(f"""
SELECT {ITEM_RESULT} FROM (
    SELECT * FROM capped WHERE jan % 5 <> 0 UNION ALL SELECT * FROM best WHERE jan % 5 = 0)"""))

# the same steps from other probabilities, without the dropped item
QUERIES["batch_recommend"] = QUERIES["best_customer_price"].replace(
    "predictions AS (\nSELECT", "predictions AS (SELECT * REPLACE ("
    "LEAST(1, GREATEST(0, 1.5 * prob_jan - 0.25)) AS prob_jan, "
    "LEAST(1, GREATEST(0, 1.5 * prob_lv5 - 0.25)) AS prob_lv5) FROM (\nSELECT", 1).replace(
    "g(dp))", "g(dp)) WHERE jan <> 4)", 1)
# the same cases from sales of a padded period only
QUERIES["case_master_period"] = QUERIES["case_master_up"].replace(
    "FROM receipts WHERE", "FROM receipts WHERE salesday BETWEEN DATE '1996-10-08' "
    "AND DATE '2000-02-24' AND")

QUERIES["train_days"] = _sql("SELECT * FROM days").replace("uid IS NOT NULL", "uid IS NOT NULL AND uid <> 1") + f"""
WHERE salesday BETWEEN (SELECT MIN(astart) FROM ({QUERIES["case_master_period"]})) - INTERVAL 63 DAY
                   AND (SELECT MAX(astart) FROM ({QUERIES["case_master_period"]})) + INTERVAL 34 DAY
  AND store_cd IN (SELECT store_cd FROM ({QUERIES["case_master_period"]}))"""
QUERIES["train_days_by_store"] = _sql("SELECT d.* FROM days d").replace("uid IS NOT NULL", "uid IS NOT NULL AND uid <> 1") + f"""
JOIN (SELECT store_cd, MIN(astart) - INTERVAL 63 DAY AS first, MAX(astart) + INTERVAL 34 DAY AS last
      FROM ({QUERIES["case_master_period"]}) WHERE store_cd = 0 OR astart > DATE '1998-06-01' GROUP BY store_cd) b
  ON b.store_cd = d.store_cd AND d.salesday BETWEEN b.first AND b.last"""
QUERIES["oversample_weights"] = QUERIES["oversample"]
QUERIES["median_fill"] = f"SELECT l_orderkey, quantity, price FROM ({QUERIES['median_fill_exact']})"

# -- forests by rule: splits 1 to 15 and leaves 16 to 31 of each tree, numbered like a heap ---------------

ITEM_INPUTS = ("dprice dprice_pct rscore fscore mscore rfm_score rfm_score2 jan_loy_m jan_loy_f jan_loy pscore_item "
               "pscore_ucate pscore_ucate_dis050 kani_score kani_score_dis025").split()
CATEGORY_INPUTS = ("pprice aprice dprice dprice_pct unitp_cate pscore_ucate unitp_uid pscore_ucate_dis050 f_lv5 m_lv5 "
                   "jan_loy_m jan_loy_f jan_loy kani_score kani_score_dis025").split()
RANGES = {"dprice": (0, 30), "dprice_pct": (0, 0.25), "pprice": (100, 300), "aprice": (100, 300), "f_lv5": (0, 12),
          "m_lv5": (0, 9000), "pscore_item": (-0.5, 0.5), "pscore_ucate": (-0.5, 0.5), "kani_score": (0, 0.5),
          "kani_score_dis025": (0, 0.25)}


def _next(seed: str, inputs: int) -> str:
    """The next node of a row (x, lows, spans) at `node` of `tree`."""
    place = f"((5 * tree + 3 * node + {seed}) % {inputs} + 1)"
    part = f"(((37 * tree + 11 * node + 17 * {seed}) % 97 + 1) / CAST(98 AS DOUBLE))"
    return f"CASE WHEN x[{place}] <= lows[{place}] + spans[{place}] * {part} THEN 2 * node ELSE 2 * node + 1 END"


def _share(seed: str) -> str:
    return f"((13 * tree + 29 * node + 7 * {seed}) % 129) / CAST(128 AS DOUBLE)"


QUERIES["forest_score"] = f"""
WITH RECURSIVE ends AS (
    SELECT [MIN(l_quantity), MIN(l_extendedprice), MIN(l_discount), MIN(l_partkey % 50),
            MIN(l_linenumber) FILTER (l_linenumber <> 3)] AS lows,
           [MAX(l_quantity), MAX(l_extendedprice), MAX(l_discount), MAX(l_partkey % 50),
            MAX(l_linenumber) FILTER (l_linenumber <> 3)] AS highs FROM lineitem),
walk AS (
    SELECT id, l_orderkey, l_linenumber, t.tree, 1 AS node,
           [l_quantity, l_extendedprice, l_discount, CAST(l_partkey % 50 AS DOUBLE),
            CASE WHEN l_linenumber <> 3 THEN l_linenumber ELSE 2.5 END::DOUBLE] AS x, lows,
           list_transform(range(1, 6), lambda i: highs[i] - lows[i]) AS spans
    FROM (SELECT *, ROW_NUMBER() OVER () AS id FROM lineitem), ends, (SELECT UNNEST(range(0, 7)) AS tree) t
    UNION ALL SELECT id, l_orderkey, l_linenumber, tree, {_next('0', 5)}, x, lows, spans FROM walk WHERE node < 16)
SELECT l_orderkey, l_linenumber, ROUND(AVG(share), 9) AS prob,
       CAST(CASE WHEN AVG(share) > 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS class
FROM (SELECT *, {_share('0')} AS share FROM walk WHERE node >= 16) GROUP BY id, l_orderkey, l_linenumber"""

TARGETS = f"""
SELECT DISTINCT store_cd, lv4_nm, lv5_nm, jan, price AS pprice, price AS aprice, DATE '{UPDAY}' AS astart
FROM (SELECT *, MIN(price) OVER (PARTITION BY store_cd, jan) AS low, MAX(price) OVER (PARTITION BY store_cd, jan) AS high
      FROM price_rows WHERE salesday BETWEEN DATE '{UPDAY}' - INTERVAL 75 DAY AND DATE '{UPDAY}' - INTERVAL 1 DAY
                        AND jan IN (SELECT jan FROM items WHERE jan <> 4))
WHERE low = high"""


def _grid_inputs(inputs: list[str]) -> str:
    own = {"aprice": "pprice + dp", "dprice": "CAST(dp AS DOUBLE)", "dprice_pct": "dp / pprice"}
    return "[" + ", ".join(own.get(c, c) for c in inputs) + "]"


def _ends(inputs: list[str], place) -> str:
    return "[" + ", ".join(f"CAST({place(*RANGES.get(c, (0, 1)))} AS DOUBLE)" for c in inputs) + "]"


_BATCH_STEPS = {
    "cases": TARGETS,
    "known": _features("rfm_case", "loyal", "sensitive", "kani_case", CASE)
    .replace("ROUND(COALESCE(kani_score, 0), 9)", "COALESCE(kani_score, 0)")
    .replace("ROUND(ABS(COALESCE(kani_score, 0) - 0.25), 9)", "ABS(COALESCE(kani_score, 0) - 0.25)")
    .replace("SELECT store_cd", "SELECT sample_amt_jan, store_cd", 1),
    # item models have an even seed, category models the one above; the first two are for unchanged prices
    "walk": f"""
SELECT store_cd, lv4_nm, lv5_nm, jan, uid, sample_amt_jan, pprice, dp, tree, 1 AS node, seed,
       CASE WHEN seed % 2 = 0 THEN {_grid_inputs(ITEM_INPUTS)} ELSE {_grid_inputs(CATEGORY_INPUTS)} END AS x,
       CASE WHEN seed % 2 = 0 THEN {_ends(ITEM_INPUTS, lambda a, b: a)} ELSE {_ends(CATEGORY_INPUTS, lambda a, b: a)} END AS lows,
       CASE WHEN seed % 2 = 0 THEN {_ends(ITEM_INPUTS, lambda a, b: b - a)}
            ELSE {_ends(CATEGORY_INPUTS, lambda a, b: b - a)} END AS spans
FROM known, (VALUES (0, 0), (0, 1), (10, 2), (10, 3), (20, 2), (20, 3), (30, 2), (30, 3)) g(dp, seed),
     (SELECT UNNEST(range(0, 7)) AS tree) t
UNION ALL SELECT store_cd, lv4_nm, lv5_nm, jan, uid, sample_amt_jan, pprice, dp, tree, {_next('seed', 15)}, seed, x, lows, spans
FROM walk WHERE node < 16""",
    "predictions": f"""
SELECT store_cd, lv4_nm, lv5_nm, jan, uid, sample_amt_jan, pprice, CAST(dp AS INTEGER) AS dp,
       AVG(share) FILTER (seed % 2 = 0) AS prob_jan, AVG(share) FILTER (seed % 2 = 1) AS prob_lv5
FROM (SELECT *, {_share('seed')} AS share FROM walk WHERE node >= 16) GROUP BY ALL""",
}


def _batch(select: str) -> str:
    kept = dict(STEPS)
    for name, step in _BATCH_STEPS.items():
        if name not in STEPS:  # new steps stand before the ones that read them
            place = list(STEPS).index("predictions")
            items = list(STEPS.items())
            items.insert(place, (name, step))
            STEPS.clear()
            STEPS.update(items)
        else:
            STEPS[name] = step
    sql = _sql(select).replace("WITH ", "WITH RECURSIVE ", 1)
    STEPS.clear()
    STEPS.update(kept)
    return sql


QUERIES["batch_predict_grid"] = _batch(f"""
SELECT store_cd, lv4_nm, lv5_nm, jan, DATE '{UPDAY}' AS astart, pprice, uid, sample_amt_jan, dp,
       ROUND(prob_jan, 9) AS prob_jan, ROUND(prob_lv5, 9) AS prob_lv5 FROM predictions""")
QUERIES["batch_predict"] = _batch("""
SELECT store_cd, lv4_nm, lv5_nm, jan, name, pprice, rec_price, uid AS id, id_rec_price,
       GREATEST(rec_price - id_rec_price, 0) AS disc_price
FROM (SELECT s.* EXCLUDE (rec_price), b.rec_price,
             CASE WHEN s.prof_ch < 0 THEN s.pprice ELSE s.rec_price END AS id_rec_price
      FROM (SELECT * FROM simulated QUALIFY ROW_NUMBER() OVER (
                PARTITION BY store_cd, jan, uid ORDER BY prof_ch DESC, rec_price) = 1) s
      JOIN best b ON b.store_cd = s.store_cd AND b.jan = s.jan)""")
QUERIES["forest_agreement"] = _sql("""
SELECT CAST(dp AS INTEGER) AS dp, COUNT(*) AS predictions, CAST(0 AS BIGINT) AS apart
FROM base CROSS JOIN (VALUES (0), (10), (20), (30)) g(dp) GROUP BY dp""")
QUERIES["model_manifest"] = " UNION ALL ".join(
    f"SELECT 1 AS version, '{name}' AS model, {place} AS place, '{c}' AS feature, 2 AS trees, 2 AS classes, "
    f"(SELECT QUANTILE_DISC((l_quantity * {i + 1} + l_partkey) % {10 + i} + l_discount, 0.5) FROM lineitem "
    f"WHERE (l_linenumber + {i}) % 7 <> 0) AS filled"
    for name, inputs in (("jan", ITEM_INPUTS), ("lv5", CATEGORY_INPUTS)) for place, c in enumerate(inputs)
    for i in [list(dict.fromkeys([*ITEM_INPUTS, *CATEGORY_INPUTS])).index(c)])
