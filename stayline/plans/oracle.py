"""The catalog's queries as SQL over the raw test tables, for a comparison in another engine.

Queries that train a model are compared by what every sound model gives: rows, ranges, thresholds.
"""

from __future__ import annotations

# Fixed values, written out here too, so that a wrong entry of the library shows as a difference.
V6 = ["heart_rate", "bp_systolic", "bp_diastolic", "temperature_f", "respiratory_rate", "spo2"]
MODEL_FEATURES = [
    "age_at_admission", "length_of_stay", "num_diagnoses", "num_medications", "avg_hr", "max_bp_sys",
    "avg_temp", "max_creatinine", "max_wbc", "num_prior_admissions",
]
SERVED_FEATURES = [
    "age_at_admission", "length_of_stay", "num_diagnoses", "num_medications", "max_creatinine",
    "max_wbc", "num_prior_admissions",
]
LAB_ITEMS = {
    50912: "Creatinine", 51006: "Blood Urea Nitrogen", 51301: "White Blood Cells", 51222: "Hemoglobin",
    50983: "Sodium", 50971: "Potassium", 50931: "Glucose", 51003: "Troponin T", 50813: "Lactate", 50862: "Albumin",
    51265: "Platelet Count", 50882: "Bicarbonate", 50893: "Calcium Total", 50902: "Chloride",
}
TEXT_LIMITS = {
    "patient": {"gender": 1},
    "encounter": {
        "admission_type": 100, "admission_location": 100, "discharge_location": 100,
        "insurance": 50, "marital_status": 50, "race": 100,
    },
    "icu_stay": {"first_careunit": 50, "last_careunit": 50},
    "diagnosis": {"icd_code": 20},
    "medication": {"drug_type": 50, "route": 50},
    "lab_result": {"lab_name": 100, "valueuom": 20, "flag": 20},
    "vital_sign": {"vital_type": 50, "unit": 20},
}
_IN6 = ", ".join(f"'{v}'" for v in V6)


def _r(name: str, expr: str | None = None) -> str:
    return f"ROUND({expr or name}, 6) AS {name}"


def _rounded(names, prefix: str = "") -> str:
    return ", ".join(_r(n, prefix + n) for n in names)


def _pivot() -> str:
    return ", ".join(f"AVG(CASE WHEN vital_type = '{v}' THEN value END) AS {v}" for v in V6)


_EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"
_VITAL = (
    "CASE event_id % 10 WHEN 0 THEN 'heart_rate' WHEN 1 THEN 'bp_systolic' WHEN 2 THEN 'bp_diastolic' "
    "WHEN 3 THEN 'temperature_f' WHEN 4 THEN 'respiratory_rate' WHEN 5 THEN 'spo2' WHEN 6 THEN 'gcs_eye' "
    "WHEN 7 THEN 'gcs_verbal' ELSE 'gcs_motor' END"
)
_UNIT = (
    "CASE event_id % 10 WHEN 0 THEN 'bpm' WHEN 1 THEN 'mmHg' WHEN 2 THEN 'mmHg' WHEN 3 THEN 'F' "
    "WHEN 4 THEN 'br/min' WHEN 5 THEN '%' ELSE 'points' END"
)
_DAYS = "epoch(discharge_time - admit_time) / 86400.0"
_LAB_NAMES = list(LAB_ITEMS.items())
_LAB_CODE = "CASE l_partkey % 15 " + " ".join(
    f"WHEN {i} THEN {code}" for i, (code, _) in enumerate(_LAB_NAMES)) + " END"
_LAB_NAME = "CASE l_partkey % 15 " + " ".join(
    f"WHEN {i} THEN '{name}'" for i, (_, name) in enumerate(_LAB_NAMES)) + " END"

# name -> (names of the parts it builds on, SQL)
PARTS: dict[str, tuple[str, str]] = {
    "patient": ("", """
        SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
               CAST(20 + c_custkey % 70 AS INT) AS anchor_age, CAST(1995 AS INT) AS anchor_year,
               CASE WHEN c_custkey % 17 = 0 THEN DATE '2002-01-01' END AS dod
        FROM customer"""),
    "encounter": ("", """
        SELECT o_orderkey AS encounter_id, o_custkey AS patient_id,
               o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS admit_time,
               CASE WHEN o_orderkey % 97 <> 0 THEN
                 o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 + 1 + o_orderkey % 400 AS INT)
               END AS discharge_time,
               o_orderpriority AS admission_type,
               CASE o_orderkey % 3 WHEN 0 THEN 'EMERGENCY ROOM' WHEN 1 THEN 'CLINIC REFERRAL' ELSE 'TRANSFER' END
                 AS admission_location,
               o_orderstatus AS discharge_location,
               CASE o_orderkey % 4 WHEN 0 THEN 'Medicare' WHEN 1 THEN 'Medicaid' WHEN 2 THEN 'Private' END AS insurance,
               CASE o_orderkey % 3 WHEN 0 THEN 'SINGLE' WHEN 1 THEN 'MARRIED' ELSE 'WIDOWED' END AS marital_status,
               'GROUP-' || CAST(o_orderkey % 7 AS VARCHAR) AS race,
               CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS hospital_expire_flag
        FROM orders"""),
    "icu_stay": ("", f"""
        SELECT 300000 + user_id AS icu_stay_id, user_id AS encounter_id, user_id * 7 % 2000 AS patient_id,
               CASE WHEN user_id % 2 = 0 THEN 'MICU' ELSE 'SICU' END AS first_careunit,
               CASE WHEN user_id % 3 = 0 THEN 'MICU' ELSE 'SICU' END AS last_careunit,
               {_EPOCH} + INTERVAL '1' HOUR * CAST(user_id % 24 AS INT) AS icu_intime,
               {_EPOCH} + INTERVAL '1' HOUR * CAST(user_id % 24 + user_id % 90 AS INT) AS icu_outtime,
               CAST(user_id % 90 AS DOUBLE) / 24 AS los_hours
        FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 5 <> 0) u"""),
    "vital_sign": ("", f"""
        SELECT user_id AS encounter_id, 300000 + user_id AS icu_stay_id, {_VITAL} AS vital_type, value,
               {_UNIT} AS unit, {_EPOCH} + INTERVAL '1' MINUTE * CAST(event_id * 37 % 4320 AS INT) AS recorded_at
        FROM events WHERE event_id % 10 <> 9"""),
    "lab_result": ("", """
        SELECT l_orderkey AS encounter_id, l_suppkey AS patient_id,
               CASE l_partkey % 15 WHEN 0 THEN 'Creatinine' WHEN 1 THEN 'Blood Urea Nitrogen'
                 WHEN 2 THEN 'White Blood Cells' WHEN 3 THEN 'Hemoglobin' ELSE 'Sodium' END AS lab_name,
               CAST(l_partkey % 15 AS INT) AS itemid,
               CASE WHEN l_partkey % 23 <> 0 THEN l_quantity END AS valuenum,
               CASE WHEN l_partkey % 2 = 0 THEN 'mg/dL' ELSE 'K/uL' END AS valueuom,
               CASE WHEN l_returnflag = 'R' THEN 'abnormal' END AS flag, l_shipdate AS chart_time
        FROM lineitem WHERE l_partkey % 15 <> 14"""),
    "diagnosis": ("", """
        SELECT l.l_orderkey AS encounter_id, CAST(l.l_partkey AS VARCHAR) AS icd_code,
               CAST(9 + l.l_partkey % 2 AS INT) AS icd_version, COALESCE(p.p_name, 'Unknown') AS description,
               l.l_linenumber AS seq_num
        FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_partkey % 10 <> 0"""),
    "medication": ("", """
        SELECT l_orderkey AS encounter_id,
               CASE WHEN l_partkey % 41 = 0 THEN 'Unknown' ELSE 'drug-' || CAST(l_partkey % 40 AS VARCHAR) END AS drug_name,
               l_returnflag AS drug_type, l_linestatus AS route, l_shipdate AS start_time,
               l_shipdate + INTERVAL '1' DAY * l_linenumber AS stop_time
        FROM lineitem"""),
    "score_input": ("", """
        SELECT o_orderkey AS encounter_id, CAST(o_orderkey * 37 % 1001 AS DOUBLE) / 1000 AS xgb_score,
               CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey * 53 % 1001 AS DOUBLE) / 1000 END AS lstm_score,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey * 71 % 1001 AS DOUBLE) / 1000 END AS cnn_score,
               CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'scan/PNEUMONIA_'
                 WHEN 1 THEN 'scan/normal_' WHEN 2 THEN 'scan/Virus_normal_' ELSE 'scan/other_' END
                 || CAST(o_orderkey AS VARCHAR) || '.png' END AS image_path
        FROM orders"""),
    "risk_prediction": ("", """
        SELECT l_orderkey AS encounter_id, CAST(l_suppkey * 53 % 1001 AS DOUBLE) / 1000 AS xgb_score,
               CAST(l_partkey * 37 % 1001 AS DOUBLE) / 1000 AS fusion_score,
               CASE WHEN CAST(l_partkey * 37 % 1001 AS DOUBLE) / 1000 < 0.50 THEN 'LOW'
                 WHEN CAST(l_partkey * 37 % 1001 AS DOUBLE) / 1000 < 0.54 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
               'v2_mimic' AS model_version, l_shipdate + INTERVAL '1' MINUTE * l_linenumber AS predicted_at
        FROM lineitem"""),
    "label": ("encounter", """
        SELECT encounter_id, patient_id, CAST(admit_time AS DATE) AS admit_date,
               CAST(discharge_time AS DATE) AS discharge_date, CAST(next_admit AS DATE) AS next_admit_date,
               CASE WHEN next_admit - discharge_time <= INTERVAL '30' DAY THEN 1 ELSE 0 END AS readmitted_30d
        FROM (SELECT *, LEAD(admit_time) OVER (PARTITION BY patient_id ORDER BY admit_time NULLS LAST, encounter_id)
                AS next_admit
              FROM encounter WHERE discharge_time IS NOT NULL) s"""),
    "prior": ("encounter", """
        SELECT encounter_id, RANK() OVER (PARTITION BY patient_id ORDER BY admit_time) - 1 AS num_prior_admissions
        FROM encounter"""),
    "features": ("encounter patient diagnosis medication vital_sign lab_result prior", f"""
        SELECT e.encounter_id, e.admit_time, CAST(e.admit_time AS DATE) AS admit_date,
               CAST(p.anchor_age + (year(e.admit_time) - p.anchor_year) AS INT) AS age_at_admission,
               CASE WHEN p.gender = 'M' THEN 1 ELSE 0 END AS gender,
               {_DAYS} AS length_of_stay,
               COALESCE(num_diagnoses, 0) AS num_diagnoses, COALESCE(num_medications, 0) AS num_medications,
               COALESCE(avg_hr, 0) AS avg_hr, COALESCE(max_bp_sys, 0) AS max_bp_sys, COALESCE(avg_temp, 0) AS avg_temp,
               COALESCE(max_creatinine, 0) AS max_creatinine, COALESCE(max_wbc, 0) AS max_wbc,
               COALESCE(num_prior_admissions, 0) AS num_prior_admissions
        FROM encounter e JOIN patient p ON p.patient_id = e.patient_id
        LEFT JOIN (SELECT encounter_id, COUNT(*) AS num_diagnoses FROM diagnosis GROUP BY 1) d
          ON d.encounter_id = e.encounter_id
        LEFT JOIN (SELECT encounter_id, COUNT(DISTINCT drug_name) AS num_medications FROM medication GROUP BY 1) m
          ON m.encounter_id = e.encounter_id
        LEFT JOIN (SELECT encounter_id, AVG(CASE WHEN vital_type = 'heart_rate' THEN value END) AS avg_hr,
                     MAX(CASE WHEN vital_type = 'bp_systolic' THEN value END) AS max_bp_sys,
                     AVG(CASE WHEN vital_type = 'temperature_f' THEN value END) AS avg_temp
                   FROM vital_sign GROUP BY 1) v ON v.encounter_id = e.encounter_id
        LEFT JOIN (SELECT encounter_id, MAX(CASE WHEN lab_name = 'Creatinine' THEN valuenum END) AS max_creatinine,
                     MAX(CASE WHEN lab_name = 'White Blood Cells' THEN valuenum END) AS max_wbc
                   FROM lab_result GROUP BY 1) l ON l.encounter_id = e.encounter_id
        LEFT JOIN prior r ON r.encounter_id = e.encounter_id
        WHERE e.admit_time IS NOT NULL AND e.discharge_time IS NOT NULL"""),
    "training": ("features label", """
        SELECT f.*, l.readmitted_30d AS label FROM features f JOIN label l ON l.encounter_id = f.encounter_id
        WHERE f.length_of_stay > 0"""),
    "placed": ("training", """
        SELECT *, CASE WHEN rn <= CAST(floor(n * 0.70::DOUBLE) AS BIGINT) THEN 'train'
                    WHEN rn <= CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY admit_time, encounter_id) AS rn, COUNT(*) OVER () AS n
              FROM training) t"""),
    "fills": ("placed", "SELECT " + ", ".join(
        f"median(NULLIF(CAST({c} AS DOUBLE), 0)) AS {c}" for c in MODEL_FEATURES) + " FROM placed WHERE split = 'train'"),
    "sequence": ("icu_stay vital_sign label", f"""
        SELECT s.encounter_id, r.readmitted_30d,
               CAST(FLOOR(epoch(v.recorded_at - s.icu_intime) / 3600) AS INT) AS hour_offset, {_pivot()}
        FROM icu_stay s JOIN vital_sign v ON v.icu_stay_id = s.icu_stay_id
        JOIN label r ON r.encounter_id = s.encounter_id
        WHERE v.vital_type IN ({_IN6}) AND v.recorded_at >= s.icu_intime
          AND v.recorded_at < s.icu_intime + INTERVAL '48' HOUR
        GROUP BY 1, 2, 3"""),
    "hourly": ("vital_sign", f"""
        SELECT encounter_id, date_trunc('hour', recorded_at) AS hour, {_pivot()}
        FROM vital_sign WHERE vital_type IN ({_IN6}) GROUP BY 1, 2"""),
    "hourly_any": ("vital_sign", f"""
        SELECT encounter_id, date_trunc('hour', recorded_at) AS hour, {_pivot()} FROM vital_sign GROUP BY 1, 2"""),
}


def _resolved(hourly: str, order: str = "ASC") -> str:
    cols = ", ".join(V6)
    return f"""
        SELECT encounter_id, hour_offset AS step, {cols}, 'vital_sequence' AS source FROM sequence
        UNION ALL
        SELECT encounter_id, CAST(ROW_NUMBER() OVER (PARTITION BY encounter_id ORDER BY hour {order}) - 1 AS INT) AS step,
               {cols}, 'vital_sign' AS source
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY encounter_id ORDER BY hour DESC) AS rn FROM {hourly} h
              WHERE encounter_id NOT IN (SELECT encounter_id FROM sequence)) t WHERE rn <= 48"""


def _padded(rows: str, value: str, pad: str, keep: str) -> str:
    """48 steps per encounter from ``rows``: real ones with ``value``, padding in front with ``pad``."""
    real = ", ".join(f"{value.format(v=v)} AS {v}" for v in V6)
    front = ", ".join(f"{pad.format(v=v)} AS {v}" for v in V6)
    kept = f", {keep}" if keep else ""
    names = ", ".join(V6)
    return f"""
        SELECT encounter_id{kept}, n_rows, pos, {names} FROM (
          SELECT encounter_id{kept}, n_rows, CAST(48 - n_rows + rn - 1 AS INT) AS pos, {real} FROM {rows}
          UNION ALL
          SELECT e.encounter_id{kept}, e.n_rows, g.pos, {names}
          FROM (SELECT encounter_id{kept}, n_rows, {front} FROM {rows} GROUP BY ALL) e
          JOIN (SELECT CAST(unnest(range(48)) AS INT) AS pos) g ON g.pos < 48 - e.n_rows) u"""


def _numbered(source: str, step: str) -> str:
    means = ", ".join(f"AVG({v}) OVER (PARTITION BY encounter_id) AS m_{v}" for v in V6)
    return (f"SELECT *, CAST(COUNT(*) OVER (PARTITION BY encounter_id) AS INT) AS n_rows, "
            f"ROW_NUMBER() OVER (PARTITION BY encounter_id ORDER BY {step}) AS rn, {means} FROM {source}")


_ZEROED = ", ".join(f"COALESCE({v}, 0) AS {v}" for v in V6)
_CELL_SUM = " + ".join(f"SUM({v})" for v in V6)

PARTS.update({
    "resolved": ("sequence hourly", _resolved("hourly")),
    "resolved_offline": ("sequence hourly_any", _resolved("hourly_any")),
    "resolved_newest": ("sequence hourly", _resolved("hourly", "DESC")),
    "numbered": ("resolved", _numbered("resolved", "step")),
    "numbered_offline": ("resolved_offline", _numbered("resolved_offline", "step")),
    "zeroed": ("sequence", f"SELECT encounter_id, readmitted_30d AS label, hour_offset, {_ZEROED} FROM sequence"),
    "numbered_training": ("zeroed", f"""
        SELECT * FROM ({_numbered('zeroed', 'hour_offset')}) t
        WHERE encounter_id NOT IN (
          SELECT encounter_id FROM zeroed GROUP BY encounter_id HAVING COUNT(*) >= 48 AND {_CELL_SUM} = 0)"""),
    "train_steps": ("numbered_training", _padded("numbered_training", "{v}", "m_{v}", "label")),
    "inference_steps": ("numbered", _padded("numbered", "COALESCE({v}, m_{v}, 0)", "0", "source")),
    "offline_steps": ("numbered_offline", _padded("numbered_offline", "COALESCE({v}, 0)", "0", "source")),
    "key_split": ("numbered_training", """
        SELECT encounter_id, label, CASE WHEN rn <= CAST(floor(n * 0.70::DOUBLE) AS BIGINT) THEN 'train'
                    WHEN rn <= CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY encounter_id) AS rn, COUNT(*) OVER () AS n
              FROM (SELECT DISTINCT encounter_id, label FROM numbered_training) d) t"""),
    "scored": ("label score_input", """
        SELECT l.encounter_id, l.readmitted_30d AS label, s.xgb_score AS score
        FROM label l JOIN score_input s ON s.encounter_id = l.encounter_id"""),
    "scored_prior": ("label prior", """
        SELECT l.encounter_id, l.readmitted_30d AS label, CAST(s.num_prior_admissions AS DOUBLE) AS score
        FROM label l JOIN prior s ON s.encounter_id = l.encounter_id"""),
    "fused": ("score_input", """
        SELECT *, CASE WHEN fusion_score < 0.50 THEN 'LOW' WHEN fusion_score < 0.54 THEN 'MEDIUM' ELSE 'HIGH' END
                 AS risk_level
        FROM (SELECT *, ROUND(xw * xgb_score + lw * COALESCE(lstm_score, 0) + cw * COALESCE(cnn_score, 0), 4) AS fusion_score
              FROM (SELECT *,
                CAST(CASE WHEN lstm_score IS NOT NULL AND cnn_score IS NOT NULL THEN 0.5 WHEN lstm_score IS NOT NULL THEN 0.6
                  WHEN cnn_score IS NOT NULL THEN 0.7 ELSE 1.0 END AS DOUBLE) AS xw,
                CAST(CASE WHEN lstm_score IS NOT NULL AND cnn_score IS NOT NULL THEN 0.3 WHEN lstm_score IS NOT NULL THEN 0.4
                  ELSE 0.0 END AS DOUBLE) AS lw,
                CAST(CASE WHEN lstm_score IS NOT NULL AND cnn_score IS NOT NULL THEN 0.2 WHEN lstm_score IS NOT NULL THEN 0.0
                  WHEN cnn_score IS NOT NULL THEN 0.3 ELSE 0.0 END AS DOUBLE) AS cw
                FROM score_input) w) f"""),
    # typed rows as the loaders leave them
    "loaded_encounter": ("encounter", """
        SELECT encounter_id, patient_id, admit_time, discharge_time,
               CASE WHEN encounter_id % 301 <> 0 THEN admission_type END AS admission_type, admission_location,
               discharge_location, insurance, marital_status, race, hospital_expire_flag
        FROM encounter WHERE encounter_id % 211 <> 0 AND discharge_time IS NOT NULL"""),
    "loaded_vital": ("", f"""
        SELECT user_id AS encounter_id, 300000 + user_id AS icu_stay_id, {_VITAL} AS vital_type, value, {_UNIT} AS unit,
               CASE WHEN event_id % 107 <> 0 THEN
                 {_EPOCH} + INTERVAL '1' MINUTE * CAST(event_id * 37 % 4320 AS INT) END AS recorded_at
        FROM events WHERE event_id % 10 <> 9 AND event_id % 101 <> 0 AND event_id % 103 <> 0"""),
    "loaded_medication": ("", """
        SELECT l_orderkey AS encounter_id,
               CASE WHEN l_partkey % 41 = 0 THEN 'Unknown' ELSE 'drug-' || CAST(l_partkey % 40 AS VARCHAR) END AS drug_name,
               l_returnflag AS drug_type, l_linestatus AS route, l_shipdate AS start_time,
               CASE WHEN l_linenumber <> 3 THEN l_shipdate + INTERVAL '1' DAY * l_linenumber END AS stop_time
        FROM lineitem WHERE l_partkey % 31 <> 0"""),
    "loaded_lab": ("", f"""
        SELECT l_orderkey AS encounter_id, l_suppkey AS patient_id, {_LAB_NAME} AS lab_name,
               CAST({_LAB_CODE} AS INT) AS itemid,
               CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.0' AS value,
               CASE WHEN l_partkey % 23 <> 0 THEN l_quantity END AS valuenum, 'mg/dL' AS valueuom,
               CASE WHEN l_returnflag = 'R' THEN 'abnormal' END AS flag, l_shipdate AS chart_time
        FROM lineitem WHERE l_partkey % 15 <> 14 AND l_partkey % 29 <> 0"""),
})


def _sample(source: str, cap: int = 3000) -> str:
    return f"""
        SELECT * FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY admission_type
                    ORDER BY md5('42:' || CAST(encounter_id AS VARCHAR))) AS rn,
                 COUNT(*) OVER (PARTITION BY admission_type) AS n, (SELECT COUNT(*) FROM {source}) AS tot
          FROM {source}) s
        WHERE admission_type IS NOT NULL AND rn <= LEAST(n, CAST(FLOOR({cap}.0 * n / tot) AS BIGINT) + 1)
        ORDER BY admission_type, rn LIMIT {cap}"""


PARTS.update({
    "discharged": ("encounter", "SELECT * FROM encounter WHERE discharge_time IS NOT NULL"),
    "sample": ("discharged", _sample("discharged")),
    "loaded_sample": ("loaded_encounter", _sample("loaded_encounter")),
})


def _sql(parts: str, body: str) -> str:
    """``body`` with the parts it uses, and theirs, as common table expressions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for needed in PARTS[name][0].split():
                visit(needed)
            ordered.append(name)

    for name in parts.split():
        visit(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in ordered) + "\n" + body


_METRICS = """
    SELECT CAST(SUM(p + n) AS BIGINT) AS rows, CAST(SUM(p) AS BIGINT) AS positives,
           ROUND(SUM(p * (below + n / 2.0)) / (SUM(p) * SUM(n)), 6) AS roc_auc,
           ROUND(SUM(CAST(p AS DOUBLE) * tp / pp) / SUM(p), 6) AS average_precision
    FROM (SELECT score, p, n,
                 COALESCE(SUM(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
                 SUM(p) OVER (ORDER BY score DESC) AS tp, SUM(p + n) OVER (ORDER BY score DESC) AS pp
          FROM (SELECT score, SUM(label) AS p, SUM(1 - label) AS n FROM {rows} GROUP BY score) g) c"""

_ROUND_FEATURES = "encounter_id, admit_time, admit_date, age_at_admission, gender, " + ", ".join(
    _r(c) if c in ("length_of_stay", "avg_hr", "avg_temp") else c for c in MODEL_FEATURES[1:])


def _aligned(served: list[str]) -> str:
    def value(c: str) -> str:
        if c not in served:
            return f"CAST(0 AS DOUBLE) AS {c}"
        e = f"CAST({c} AS DOUBLE)"
        return _r(c, e) if c in ("length_of_stay", "avg_hr") else f"{e} AS {c}"

    return "SELECT encounter_id, " + ", ".join(value(c) for c in MODEL_FEATURES) + " FROM features"


def _matrix(condition: str) -> str:
    def value(c: str) -> str:
        v = f"CAST(p.{c} AS DOUBLE)"
        return _r(c, f"CASE WHEN {condition} THEN COALESCE(NULLIF({v}, 0), f.{c}, 0) ELSE {v} END")

    return ("SELECT p.encounter_id, p.split, p.label, " + ", ".join(value(c) for c in MODEL_FEATURES)
            + " FROM placed p CROSS JOIN fills f")


def _offline(image_model: bool) -> str:
    terms = "0.1 * xgb_score + 0.1 * lstm + 0.8 * COALESCE(cnn_score, 0)" if image_model else "0.5 * xgb_score + 0.5 * lstm"
    terms = terms.replace("0.1 *", "0.1::DOUBLE *").replace("0.8 *", "0.8::DOUBLE *").replace("0.5 *", "0.5::DOUBLE *")
    w = (0.1, 0.1, 0.8) if image_model else (0.5, 0.5, 0.0)
    return f"""
        SELECT encounter_id, ROUND(x, 4) AS fusion_score,
               CASE WHEN x < 0.3 THEN 'LOW' WHEN x < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
               {w[0]}::DOUBLE AS xgb_weight, {w[1]}::DOUBLE AS lstm_weight, {w[2]}::DOUBLE AS cnn_weight
        FROM (SELECT encounter_id, LEAST(GREATEST({terms}, 0), 1) AS x
              FROM (SELECT *, COALESCE(lstm_score, 0.5::DOUBLE) AS lstm FROM score_input) i) s"""


def _report() -> str:
    def cls(name, hit, other, missed):
        return (f"SELECT '{name}' AS class, COALESCE({hit} / NULLIF({hit} + {other}, 0), 0) AS p, "
                f"COALESCE({hit} / NULLIF({hit} + {missed}, 0), 0) AS r, {hit} + {missed} AS s FROM k")

    return f"""
        , k AS (SELECT CAST(count(*) FILTER (label = 0 AND score <= 0.5) AS DOUBLE) AS tn,
                       CAST(count(*) FILTER (label = 0 AND score > 0.5) AS DOUBLE) AS fp,
                       CAST(count(*) FILTER (label = 1 AND score <= 0.5) AS DOUBLE) AS fn,
                       CAST(count(*) FILTER (label = 1 AND score > 0.5) AS DOUBLE) AS tp FROM scored),
        c AS (SELECT *, COALESCE(2 * p * r / NULLIF(p + r, 0), 0) AS f FROM (
              {cls('Not Readmitted', 'tn', 'fn', 'fp')} UNION ALL {cls('Readmitted', 'tp', 'fp', 'fn')}) b)
        SELECT class, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM c
        UNION ALL SELECT 'accuracy', ROUND((tn + tp) / (tn + fp + fn + tp), 6), ROUND((tn + tp) / (tn + fp + fn + tp), 6),
          ROUND((tn + tp) / (tn + fp + fn + tp), 6), CAST(tn + fp + fn + tp AS BIGINT) FROM k
        UNION ALL SELECT 'macro avg', ROUND(AVG(p), 6), ROUND(AVG(r), 6), ROUND(AVG(f), 6), CAST(SUM(s) AS BIGINT) FROM c
        UNION ALL SELECT 'weighted avg', ROUND(SUM(p * s) / SUM(s), 6), ROUND(SUM(r * s) / SUM(s), 6),
          ROUND(SUM(f * s) / SUM(s), 6), CAST(SUM(s) AS BIGINT) FROM c"""


_LISTING = f"""encounter_id, patient_id, CAST(admit_time AS DATE) AS admit_date,
    CAST(discharge_time AS DATE) AS discharge_date, admission_type, discharge_location, ROUND({_DAYS}, 6) AS los_days"""
_FILTER_FLAT = "(SQRT(var_pop(x)) < 1e-3 OR MAX(x) < 1e-3)"
_UNPIVOT = "unnest([" + ", ".join(V6) + "])"
_SCALER = " UNION ALL ".join(
    f"SELECT {i} AS position, '{v}' AS vital, AVG({v}) AS mean, stddev_pop({v}) AS std FROM {{rows}}" for i, v in enumerate(V6))
_LOG_COLUMNS = ", ".join(f"ROUND({c}, 4) AS {c}" for c in ("xgb_score", "lstm_score", "cnn_score", "fusion_score"))


def _scaled(rows: str, stats: str, divisor: str, extra: str) -> str:
    stat = ", ".join(f"AVG({v}) AS m_{v}, {divisor.format(s=f'stddev_pop({v})')} AS d_{v}" for v in V6)
    return (f"SELECT t.encounter_id{extra}, pos, " + ", ".join(_r(v, f"(t.{v} - m_{v}) / d_{v}") for v in V6)
            + f" FROM {rows} CROSS JOIN (SELECT {stat} FROM {stats}) z")


def _orphan(child: str, key: str, parent: str) -> str:
    return (f"SELECT '{child}.{key} -> {parent}' AS constraint_name, COUNT(*) AS n FROM {child} c "
            f"WHERE c.{key} IS NOT NULL AND c.{key} NOT IN (SELECT {key} FROM {parent})")


_ORPHANS = " UNION ALL ".join(_orphan(*x) for x in (
    ("encounter", "patient_id", "patient"), ("icu_stay", "encounter_id", "encounter"), ("icu_stay", "patient_id", "patient"),
    ("diagnosis", "encounter_id", "encounter"), ("medication", "encounter_id", "encounter")))
_DUPLICATES = " UNION ALL ".join(
    f"SELECT '{t}.{k} unique', COUNT(*) FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING COUNT(*) > 1 OR {k} IS NULL) d"
    for t, k in (("patient", "patient_id"), ("encounter", "encounter_id"), ("icu_stay", "icu_stay_id")))
_LENGTHS = " UNION ALL ".join(
    f"SELECT '{t}.{c} length', COUNT(*) FROM {t} WHERE LENGTH({c}) > {n}" for t, cs in TEXT_LIMITS.items() for c, n in cs.items())
#: Tables with violations of every kind, and the audit of them.
_AUDITED = """
    people AS (SELECT * FROM patient WHERE patient_id % 37 <> 0),
    a_patient AS (SELECT * FROM people UNION ALL SELECT * FROM people WHERE patient_id % 100 = 1 UNION ALL
                  SELECT * REPLACE (CAST(NULL AS BIGINT) AS patient_id, 'MALE' AS gender) FROM people WHERE patient_id % 50 = 2),
    stays AS (SELECT * REPLACE (CASE WHEN encounter_id % 29 = 0 THEN repeat(race, 20) ELSE race END AS race)
              FROM encounter WHERE encounter_id % 41 <> 0),
    a_encounter AS (SELECT * FROM stays UNION ALL SELECT * FROM stays WHERE encounter_id % 300 = 5),
    a_icu_stay AS (SELECT * REPLACE (CASE WHEN encounter_id % 17 <> 0 THEN encounter_id END AS encounter_id) FROM icu_stay),
    a_medication AS (SELECT * REPLACE (CASE WHEN encounter_id % 31 = 0 THEN repeat(route, 60) ELSE route END AS route) FROM medication),
    a_diagnosis AS (SELECT * FROM diagnosis), a_lab_result AS (SELECT * FROM lab_result), a_vital_sign AS (SELECT * FROM vital_sign)"""
_A_ORPHANS = " UNION ALL ".join(
    f"SELECT '{c}.{k} -> {p}' AS constraint_name, COUNT(*) AS n FROM a_{c} c WHERE c.{k} IS NOT NULL "
    f"AND NOT EXISTS (SELECT 1 FROM a_{p} p WHERE p.{k} = c.{k})" for c, k, p in (
        ("encounter", "patient_id", "patient"), ("icu_stay", "encounter_id", "encounter"), ("icu_stay", "patient_id", "patient"),
        ("diagnosis", "encounter_id", "encounter"), ("medication", "encounter_id", "encounter")))
_A_OTHERS = f"{_DUPLICATES} UNION ALL {_LENGTHS}".replace(" FROM ", " FROM a_").replace("a_(", "(")
_ALL7 = "patient encounter icu_stay diagnosis medication lab_result vital_sign"
_TRAINING_ROUNDED = f"SELECT {_ROUND_FEATURES}, label FROM training"


def _counts(pairs) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS tbl, COUNT(*) AS n FROM {source}" for name, source in pairs)


_STEP = f"pos, {_rounded(V6)}"

#: Rows with a label and a score that is a number, of scores with gaps.
_GAPS = "SELECT * FROM scored WHERE encounter_id % 5 > 1 AND encounter_id % 7 <> 0 AND score IS NOT NULL"

ORACLE: dict[str, str] = {
    # sources and sinks
    "csv_extract_scan": _sql("loaded_encounter", "SELECT * FROM loaded_encounter"),
    "csv_event_scan": _sql("loaded_vital", "SELECT * FROM loaded_vital"),
    "table_append": _sql("medication", "SELECT * FROM medication"),
    "table_reload": _sql("patient", "SELECT * FROM patient"),
    "failed_reload": _sql(_ALL7, _counts([(t, t) for t in _ALL7.split()])),
    "partition_reload": _sql("medication", """
        SELECT encounter_id, CASE WHEN route = 'F' THEN UPPER(drug_name) ELSE drug_name END AS drug_name, route
        FROM medication"""),
    "prediction_log_append": _sql(
        "fused", f"SELECT encounter_id, {_LOG_COLUMNS}, risk_level, 'v2_mimic' AS model_version FROM fused"),
    "embedding_lookup": """
        SELECT vec_id AS encounter_id, 'cnn' AS embedding_type, embedding AS vector FROM embeddings
        WHERE label % 2 = 0 AND vec_id IN (SELECT o_orderkey FROM orders)""",
    "note_lookup": """
        SELECT doc_id AS encounter_id, source AS note_type, text FROM documents
        WHERE doc_id IN (SELECT o_orderkey FROM orders)""",
    "present_columns": _sql("lab_result", """
        SELECT encounter_id, patient_id, lab_name, itemid, valuenum, valueuom, flag, chart_time FROM lab_result"""),
    "ingest_summary": _sql(
        f"loaded_encounter {_ALL7} loaded_vital loaded_medication loaded_lab", _counts([
            ("patient", "patient WHERE patient_id IN (SELECT patient_id FROM loaded_encounter)"),
            ("encounter", "loaded_encounter"),
            *[(t, f"{s} WHERE encounter_id IN (SELECT encounter_id FROM loaded_encounter)") for t, s in (
                ("icu_stay", "icu_stay"), ("diagnosis", "diagnosis"), ("medication", "loaded_medication"),
                ("vital_sign", "loaded_vital"), ("lab_result", "loaded_lab"))],
        ])),
    "sampled_ingest_summary": _sql(
        f"loaded_sample {_ALL7} loaded_vital loaded_medication loaded_lab", _counts([
            ("patient", "patient WHERE patient_id IN (SELECT patient_id FROM loaded_sample)"),
            ("encounter", "loaded_sample"),
            *[(t, f"{s} WHERE encounter_id IN (SELECT encounter_id FROM loaded_sample)") for t, s in (
                ("icu_stay", "icu_stay"), ("diagnosis", "diagnosis"), ("medication", "loaded_medication"),
                ("vital_sign", "loaded_vital"), ("lab_result", "loaded_lab"))],
        ])),
    # loaders
    "loaded_patients": _sql("patient", "SELECT * FROM patient"),
    "loaded_encounters": _sql("loaded_encounter", "SELECT * FROM loaded_encounter"),
    "loaded_icu_stays": _sql("icu_stay", """
        SELECT * REPLACE (CASE WHEN encounter_id % 13 <> 0 THEN icu_outtime END AS icu_outtime,
                          ROUND(los_hours, 6) AS los_hours) FROM icu_stay"""),
    "loaded_diagnoses": _sql("diagnosis", "SELECT * FROM diagnosis"),
    "loaded_medications": _sql("loaded_medication", "SELECT * FROM loaded_medication"),
    "loaded_vitals": _sql("loaded_vital", "SELECT * FROM loaded_vital"),
    "loaded_labs": _sql("loaded_lab", "SELECT * FROM loaded_lab"),
    "sampled_labs": _sql("loaded_sample loaded_lab", """
        SELECT * FROM loaded_lab WHERE encounter_id IN (SELECT encounter_id FROM loaded_sample)"""),
    "capped_vitals": _sql("loaded_vital", """
        SELECT * FROM loaded_vital WHERE encounter_id <= (
          SELECT encounter_id FROM (SELECT encounter_id, ROW_NUMBER() OVER (ORDER BY encounter_id) AS rn,
                                           COUNT(*) OVER () AS n FROM loaded_vital) t WHERE rn = n // 2)"""),
    # lookups and reports
    "patient_lookup": _sql("patient", """
        SELECT w.patient_id, gender, anchor_age, anchor_year, dod, p.patient_id IS NOT NULL AS found
        FROM (SELECT DISTINCT o_custkey * 2 AS patient_id FROM orders) w LEFT JOIN patient p ON p.patient_id = w.patient_id"""),
    "abnormal_labs": _sql("lab_result", """
        SELECT encounter_id, lab_name, valuenum, valueuom, flag, chart_time FROM lab_result WHERE flag = 'abnormal'"""),
    "sequence_vital_rows": _sql("vital_sign", f"SELECT * FROM vital_sign WHERE vital_type IN ({_IN6})"),
    "positive_stays": _sql(
        "features", f"SELECT encounter_id, {_r('length_of_stay')} FROM features WHERE length_of_stay > 0"),
    "encounter_listing": _sql("discharged", f"SELECT {_LISTING} FROM discharged"),
    "random_encounter_listing": _sql("discharged", f"""
        SELECT {_LISTING} FROM discharged ORDER BY md5('42:' || CAST(encounter_id AS VARCHAR)) LIMIT 30"""),
    "encounter_detail": _sql("encounter patient", f"""
        SELECT e.*, p.gender, p.anchor_age, ROUND({_DAYS}, 6) AS los_days
        FROM encounter e JOIN patient p ON p.patient_id = e.patient_id"""),
    "patient_listing": _sql("patient encounter", """
        SELECT p.*, COALESCE(n, 0) AS total_encounters FROM patient p
        LEFT JOIN (SELECT patient_id, COUNT(encounter_id) AS n FROM encounter GROUP BY 1) e ON e.patient_id = p.patient_id"""),
    "top_patients": _sql("patient encounter", """
        SELECT p.*, COALESCE(n, 0) AS total_encounters FROM patient p
        LEFT JOIN (SELECT patient_id, COUNT(encounter_id) AS n FROM encounter GROUP BY 1) e ON e.patient_id = p.patient_id
        ORDER BY total_encounters DESC, p.patient_id LIMIT 50"""),
    "patient_encounters": _sql("encounter", f"""
        SELECT patient_id, encounter_id, admit_time, discharge_time, admission_type, discharge_location,
               hospital_expire_flag, ROUND({_DAYS}, 6) AS los_days FROM encounter"""),
    "diagnoses_in_order": _sql("diagnosis", "SELECT * FROM diagnosis"),
    "vitals_in_order": _sql("vital_sign", "SELECT encounter_id, vital_type, value, unit, recorded_at FROM vital_sign"),
    "distinct_medications": _sql("medication", "SELECT DISTINCT encounter_id, drug_name, drug_type, route FROM medication"),
    "lab_summary": _sql("lab_result", """
        SELECT encounter_id, lab_name, MAX(valuenum) AS max_value, MIN(valuenum) AS min_value,
               ROUND(AVG(valuenum), 6) AS avg_value, MAX(valueuom) AS unit, MAX(flag) AS flag, COUNT(*) AS num_readings
        FROM lab_result WHERE valuenum IS NOT NULL GROUP BY 1, 2"""),
    "admission_type_counts": _sql("encounter", "SELECT admission_type, COUNT(*) AS n FROM encounter GROUP BY 1"),
    "readmission_check": _sql("label", """
        SELECT COUNT(*) AS total, CAST(SUM(readmitted_30d) AS BIGINT) AS readmitted, ROUND(AVG(readmitted_30d) * 100, 2) AS rate_pct,
               MIN(admit_date) AS first_date, MAX(admit_date) AS last_date FROM label"""),
    "readmission_by_type": _sql("encounter label", """
        SELECT admission_type, COUNT(*) AS total, CAST(SUM(readmitted_30d) AS BIGINT) AS readmitted,
               ROUND(AVG(readmitted_30d) * 100, 2) AS rate_pct
        FROM encounter e JOIN label l ON l.encounter_id = e.encounter_id GROUP BY 1"""),
    "prediction_history": _sql("risk_prediction", "SELECT * FROM risk_prediction"),
    "latest_predictions": _sql("risk_prediction", """
        SELECT encounter_id, xgb_score, fusion_score, risk_level, model_version, predicted_at
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY encounter_id ORDER BY predicted_at DESC, fusion_score DESC, xgb_score DESC) AS rn
              FROM risk_prediction) t WHERE rn = 1"""),
    "prediction_summary": _sql("risk_prediction", """
        SELECT COUNT(*) AS total_predictions, ROUND(AVG(fusion_score), 6) AS avg_risk_score,
               CAST(SUM(CASE WHEN risk_level = 'HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_count,
               CAST(SUM(CASE WHEN risk_level = 'MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS medium_risk_count,
               CAST(SUM(CASE WHEN risk_level = 'LOW' THEN 1 ELSE 0 END) AS BIGINT) AS low_risk_count FROM risk_prediction"""),
    "displayed_scores": _sql("fused", """
        SELECT encounter_id, CAST(FLOOR(xgb_score * 100 + 0.5::DOUBLE) AS INT) AS xgb_pct,
               CAST(FLOOR(lstm_score * 100 + 0.5::DOUBLE) AS INT) AS lstm_pct,
               CAST(FLOOR(cnn_score * 100 + 0.5::DOUBLE) AS INT) AS cnn_pct,
               CAST(FLOOR(fusion_score * 100 + 0.5::DOUBLE) AS INT) AS fusion_pct,
               CASE risk_level WHEN 'LOW' THEN 'Low Risk' WHEN 'MEDIUM' THEN 'Medium Risk' ELSE 'High Risk' END AS risk_label,
               CAST(ROUND(NULLIF(xw, 0) * 100) AS INT) AS xgb_weight_pct, CAST(ROUND(NULLIF(lw, 0) * 100) AS INT) AS lstm_weight_pct,
               CAST(ROUND(NULLIF(cw, 0) * 100) AS INT) AS cnn_weight_pct FROM fused"""),
    "table_counts": _sql(_ALL7, _counts([(t, t) for t in _ALL7.split()])),
    # cohort, label, features
    "readmission_label": _sql("label", "SELECT * FROM label"),
    "prior_admissions": _sql("prior", "SELECT * FROM prior"),
    "stratified_sample": _sql("sample", "SELECT encounter_id, patient_id, admission_type FROM sample"),
    "diagnosis_counts": _sql("diagnosis", "SELECT encounter_id, COUNT(*) AS num_diagnoses FROM diagnosis GROUP BY 1"),
    "medication_counts": _sql(
        "medication", "SELECT encounter_id, COUNT(DISTINCT drug_name) AS num_medications FROM medication GROUP BY 1"),
    "vital_features": _sql("vital_sign", """
        SELECT encounter_id, ROUND(AVG(CASE WHEN vital_type = 'heart_rate' THEN value END), 6) AS avg_hr,
               MAX(CASE WHEN vital_type = 'bp_systolic' THEN value END) AS max_bp_sys,
               ROUND(AVG(CASE WHEN vital_type = 'temperature_f' THEN value END), 6) AS avg_temp
        FROM vital_sign WHERE vital_type IN ('heart_rate', 'bp_systolic', 'temperature_f') GROUP BY 1"""),
    "lab_features": _sql("lab_result", """
        SELECT encounter_id, MAX(CASE WHEN lab_name = 'Creatinine' THEN valuenum END) AS max_creatinine,
               MAX(CASE WHEN lab_name = 'White Blood Cells' THEN valuenum END) AS max_wbc
        FROM lab_result WHERE lab_name IN ('Creatinine', 'White Blood Cells') GROUP BY 1"""),
    "encounter_features": _sql("features", f"SELECT {_ROUND_FEATURES} FROM features"),
    "training_set": _sql("training", _TRAINING_ROUNDED),
    "feature_medians": _sql(
        "training", "SELECT " + ", ".join(_r(c, f"median(CAST({c} AS DOUBLE))") for c in MODEL_FEATURES) + " FROM training"),
    "chronological_split_of_encounters": _sql("placed", "SELECT encounter_id, admit_time, split FROM placed"),
    "split_summary_of_encounters": _sql("placed", """
        SELECT split, COUNT(*) AS rows, MIN(admit_date) AS first_date, MAX(admit_date) AS last_date,
               ROUND(AVG(label), 6) AS positive_rate FROM placed GROUP BY split"""),
    "class_weight": _sql("training", """
        SELECT CAST(SUM(label) AS BIGINT) AS pos, CAST(SUM(1 - label) AS BIGINT) AS neg, ROUND(SUM(1 - label) / CAST(SUM(label) AS DOUBLE), 6)
               AS scale_pos_weight FROM training"""),
    "training_matrix": _sql("fills", _matrix("TRUE")),
    "training_matrix_train_only": _sql("fills", _matrix("p.split = 'train'")),
    # sequences
    "hourly_vitals": _sql("hourly", f"SELECT encounter_id, hour, {_rounded(V6)} FROM hourly"),
    "hourly_vitals_any_type": _sql("hourly_any", f"SELECT encounter_id, hour, {_rounded(V6)} FROM hourly_any"),
    "vital_sequence": _sql(
        "sequence", f"SELECT encounter_id, readmitted_30d, hour_offset, {_rounded(V6)} FROM sequence"),
    "sequence_check": _sql("sequence", """
        SELECT CAST(SUM(n) AS BIGINT) AS rows, COUNT(*) AS encounters, ROUND(AVG(label), 6) AS readmission_rate
        FROM (SELECT encounter_id, COUNT(*) AS n, MIN(readmitted_30d) AS label FROM sequence GROUP BY 1) e"""),
    "latest_hours": _sql("hourly_any", """
        SELECT encounter_id, hour FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY encounter_id ORDER BY hour DESC NULLS FIRST) AS rn FROM hourly_any) t
        WHERE rn <= 48"""),
    **{name: _sql(part, f"SELECT encounter_id, step, {_rounded(V6)}, source FROM {part}") for name, part in (
        ("resolved_sequences", "resolved"), ("resolved_sequences_offline", "resolved_offline"),
        ("resolved_sequences_newest_first", "resolved_newest"))},
    "gathered_sequences": _sql(
        "numbered", f"SELECT encounter_id, n_rows, CAST(rn - 1 AS INT) AS pos, {_rounded(V6)} FROM numbered"),
    "training_sequences": _sql("train_steps", f"SELECT encounter_id, label, n_rows, {_STEP} FROM train_steps"),
    "inference_sequences": _sql("inference_steps", f"""
        SELECT i.encounter_id, source, n_rows, flat, {_STEP} FROM inference_steps i
        JOIN (SELECT encounter_id, SQRT(var_pop(x)) < 1e-3 AS flat
              FROM (SELECT encounter_id, {_UNPIVOT} AS x FROM inference_steps WHERE pos >= 48 - n_rows) c GROUP BY 1) f
          ON f.encounter_id = i.encounter_id"""),
    "inference_sequences_offline": _sql(
        "offline_steps", f"SELECT encounter_id, source, n_rows, {_STEP} FROM offline_steps"),
    "offline_flat_sequences": _sql("offline_steps", f"""
        SELECT encounter_id, {_FILTER_FLAT} AS flat
        FROM (SELECT encounter_id, {_UNPIVOT} AS x FROM offline_steps) c GROUP BY 1"""),
    "sequence_key_split": _sql("key_split", "SELECT * FROM key_split"),
    "sequence_split_summary": _sql("key_split", """
        SELECT split, COUNT(*) AS rows, ROUND(AVG(label), 6) AS positive_rate FROM key_split GROUP BY split"""),
    "sequence_scaler": _sql("train_steps", f"""
        SELECT position, vital, ROUND(mean, 6) AS mean, ROUND(std, 6) AS std FROM ({_SCALER.format(rows='train_steps')}) s"""),
    "normalised_sequences": _sql("train_steps", _scaled("train_steps t", "train_steps", "{s} + 1e-6", "")),
    "scaled_sequences": _sql("train_steps key_split", _scaled(
        "train_steps t JOIN key_split k ON k.encounter_id = t.encounter_id",
        "train_steps WHERE encounter_id IN (SELECT encounter_id FROM key_split WHERE split = 'train')",
        "CASE WHEN {s} = 0 THEN 1 ELSE {s} END", ", k.split")),
    # metrics
    "ranking_metrics": _sql("scored_prior", _METRICS.format(rows="scored_prior")),
    "roc_points": _sql("scored", """
        SELECT CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
        UNION ALL
        SELECT score, ROUND(SUM(n) OVER w / CAST(SUM(n) OVER () AS DOUBLE), 6), ROUND(SUM(p) OVER w / CAST(SUM(p) OVER () AS DOUBLE), 6)
        FROM (SELECT score, SUM(label) AS p, SUM(1 - label) AS n FROM scored GROUP BY score) g
        WINDOW w AS (ORDER BY score DESC)"""),
    "confusion_matrix": _sql("scored", """
        SELECT label, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS predicted, COUNT(*) AS n FROM scored GROUP BY 1, 2"""),
    "classification_report": _sql("scored", _report()),
    "baseline_comparison": _sql(
        "scored", f"SELECT 'baseline' AS model, CAST(0.5 AS DOUBLE) AS roc_auc UNION ALL "
                  f"SELECT 'model', roc_auc FROM ({_METRICS.format(rows='scored')}) m"),
    "overfit_check": _sql("scored", f"""
        , a AS ({_METRICS.format(rows="(SELECT * FROM scored WHERE encounter_id % 2 = 0)").replace('ROUND(SUM(p * (', '((SUM(p * (').replace('(SUM(p) * SUM(n)), 6)', '(SUM(p) * SUM(n))))')}),
        b AS ({_METRICS.format(rows="(SELECT * FROM scored WHERE encounter_id % 2 = 1)").replace('ROUND(SUM(p * (', '((SUM(p * (').replace('(SUM(p) * SUM(n)), 6)', '(SUM(p) * SUM(n))))')})
        SELECT ROUND(a.roc_auc, 6) AS train_auc, ROUND(b.roc_auc, 6) AS test_auc, ROUND(a.roc_auc - b.roc_auc, 6) AS gap,
               a.roc_auc - b.roc_auc < 0.05 AS ok FROM a, b"""),
    "ranking_metrics_with_missing_scores": _sql("scored", _METRICS.format(rows=f"({_GAPS})")),
    "roc_points_with_missing_scores": _sql("scored", f"""
        SELECT CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
        UNION ALL
        SELECT score, ROUND(SUM(n) OVER w / CAST(SUM(n) OVER () AS DOUBLE), 6), ROUND(SUM(p) OVER w / CAST(SUM(p) OVER () AS DOUBLE), 6)
        FROM (SELECT score, SUM(label) AS p, SUM(1 - label) AS n FROM ({_GAPS}) u GROUP BY score) g
        WINDOW w AS (ORDER BY score DESC)"""),
    "unranked_rows": _sql("scored", """
        SELECT COUNT(*) FILTER (encounter_id % 7 = 0) AS no_label,
               COUNT(*) FILTER (encounter_id % 7 <> 0 AND (encounter_id % 5 = 0 OR encounter_id % 5 > 1 AND score IS NULL)) AS no_score,
               COUNT(*) FILTER (encounter_id % 7 <> 0 AND encounter_id % 5 = 1) AS not_a_number FROM scored"""),
    # models: what every sound model gives
    "model_bundle": _sql("encounter features", """
        SELECT CASE WHEN encounter_id IN (SELECT encounter_id FROM features) THEN 'ok' ELSE 'no features' END AS status,
               COUNT(*) AS rows, CAST(0 AS BIGINT) AS changed FROM encounter GROUP BY 1"""),
    "tabular_model_scores": _sql(
        "placed", "SELECT split, COUNT(*) AS rows, CAST(0 AS BIGINT) AS no_probability FROM placed GROUP BY split"),
    "boosted_signal": _sql("placed", """
        SELECT split, COUNT(*) AS rows, CAST(0 AS BIGINT) AS no_probability, 'length_of_stay' AS first, TRUE AS good
        FROM placed GROUP BY split"""),
    "feature_importances": (
        f"SELECT CAST({len(MODEL_FEATURES)} AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total, "
        "CAST(0 AS BIGINT) AS out_of_order"),
    "sequence_model_scores": _sql(
        "key_split", "SELECT split, COUNT(*) AS rows, CAST(0 AS BIGINT) AS no_probability FROM key_split GROUP BY split"),
    "batch_scores": _sql("encounter features inference_steps score_input", """
        SELECT TRUE AS tabular, i.encounter_id IS NOT NULL AS sequence, s.image_path IS NOT NULL AS image,
               COUNT(*) AS rows, CAST(0 AS BIGINT) AS no_probability
        FROM encounter e JOIN features f ON f.encounter_id = e.encounter_id
        LEFT JOIN (SELECT DISTINCT encounter_id FROM inference_steps) i ON i.encounter_id = e.encounter_id
        LEFT JOIN score_input s ON s.encounter_id = e.encounter_id GROUP BY 1, 2, 3"""),
    "batch_scores_offline": _sql("encounter score_input", """
        SELECT TRUE AS tabular, TRUE AS sequence, s.image_path IS NOT NULL AS image,
               COUNT(*) AS rows, CAST(0 AS BIGINT) AS no_probability
        FROM encounter e LEFT JOIN score_input s ON s.encounter_id = e.encounter_id GROUP BY 1, 2, 3"""),
    # scoring and fusion
    "score_functions": _sql("score_input", """
        SELECT encounter_id, ROUND(1 / (1 + exp(-((xgb_score - 0.5) * 8))), 6) AS squashed,
               LEAST(GREATEST((xgb_score - 0.5) * 8, 0), 1) AS clipped,
               CASE encounter_id % 7 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE xgb_score END AS finite,
               NULLIF(xgb_score, 0) AS nonzero, CAST(FLOOR(lstm_score * 100 + 0.5::DOUBLE) AS INT) AS lstm_pct
        FROM score_input"""),
    "aligned_features": _sql("features", _aligned([c for c in MODEL_FEATURES if c != "avg_temp"])),
    "served_features": _sql("features", _aligned(SERVED_FEATURES)),
    "sequence_score_rules": _sql("score_input", """
        SELECT encounter_id, CASE WHEN encounter_id % 9 <> 0 THEN lstm_score END AS api,
               ROUND(CASE WHEN bad THEN 0.5 ELSE lstm_score END, 6) AS offline,
               ROUND(CASE WHEN bad THEN 0.5 ELSE LEAST(GREATEST((lstm_score - 0.5) * 2 + 0.5, 0), 1) END, 6) AS amplified
        FROM (SELECT *, encounter_id % 9 = 0 OR lstm_score IS NULL OR lstm_score < 0.01 AS bad FROM score_input) s"""),
    "fused_scores": _sql("fused", """
        SELECT encounter_id, fusion_score, risk_level, xw AS xgb_weight, lw AS lstm_weight, cw AS cnn_weight FROM fused"""),
    "fused_scores_offline": _sql("score_input", _offline(False)),
    "fused_scores_offline_with_images": _sql("score_input", _offline(True)),
    "image_path_scores": _sql("score_input", """
        SELECT encounter_id, CAST(CASE WHEN image_path IS NULL THEN NULL
                 WHEN contains(lower(image_path), 'pneumonia') OR contains(lower(image_path), 'virus') THEN 0.9
                 WHEN contains(lower(image_path), 'normal') THEN 0.2 ELSE 0.5 END AS DOUBLE) AS cnn_score FROM score_input"""),
    "image_brightness_scores": """
        SELECT doc_id, CAST(CASE WHEN doc_id % 11 = 0 OR text = '' THEN NULL WHEN doc_id % 5 IN (1, 2) THEN 0.1 WHEN
                 list_avg(list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: ('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::INT))
                 > 120 THEN 0.1 ELSE 0.9 END AS DOUBLE) AS cnn_score
        FROM (SELECT doc_id, text, hex(text) AS h FROM documents) d""",
    "prediction_records": _sql("fused features", """
        SELECT f.encounter_id, ROUND(xgb_score, 4) AS xgb_score, ROUND(lstm_score, 4) AS lstm_score,
               ROUND(cnn_score, 4) AS cnn_score, fusion_score, risk_level, 'v2_mimic' AS model_version, xw AS xgb_weight,
               age_at_admission, num_diagnoses, num_prior_admissions
        FROM fused f JOIN features e ON e.encounter_id = f.encounter_id"""),
    "tabular_score_status": _sql("encounter features", """
        SELECT encounter_id, CAST(NULL AS DOUBLE) AS xgb_score,
               CASE WHEN encounter_id IN (SELECT encounter_id FROM features) THEN 'no model' ELSE 'no features' END AS status
        FROM encounter"""),
    "scored_log": _sql("fused encounter", """
        SELECT f.encounter_id, ROUND(xgb_score, 4) AS xgb_score, ROUND(lstm_score, 4) AS lstm_score,
               ROUND(cnn_score, 4) AS cnn_score, fusion_score, risk_level, 'v2_mimic' AS model_version
        FROM fused f JOIN encounter e ON e.encounter_id = f.encounter_id WHERE f.encounter_id % 3 = 0"""),
    "incremental_log": _sql("encounter features", """
        SELECT e.encounter_id, CAST(1 AS BIGINT) AS times, TRUE AS sound
        FROM encounter e JOIN features f ON f.encounter_id = e.encounter_id"""),
    # quality
    "stage_counts": _sql("encounter features label training", """
        SELECT 'encounters' AS stage, COUNT(*) AS n FROM encounter
        UNION ALL SELECT 'with features', COUNT(*) FROM features
        UNION ALL SELECT 'with label', COUNT(*) FROM label
        UNION ALL SELECT 'readmitted', COUNT(*) FROM label WHERE readmitted_30d = 1
        UNION ALL SELECT 'training rows', COUNT(*) FROM training"""),
    "threshold_checks": _sql("training sequence", """
        SELECT "check", ROUND(value, 6) AS value, threshold, value >= threshold AS ok FROM (
          SELECT 'training rows' AS "check", CAST(COUNT(*) AS DOUBLE) AS value, CAST(50000 AS DOUBLE) AS threshold FROM training
          UNION ALL SELECT 'readmission rate', AVG(label), CAST(0.05 AS DOUBLE) FROM training
          UNION ALL SELECT 'sequence encounters', CAST(COUNT(DISTINCT encounter_id) AS DOUBLE), CAST(1000 AS DOUBLE)
          FROM sequence) c"""),
    "orphan_counts": _sql(_ALL7, f', {_AUDITED} SELECT constraint_name AS "constraint", n AS violations FROM ({_A_ORPHANS}) o'),
    "constraint_audit": _sql(
        _ALL7, f', {_AUDITED} SELECT constraint_name AS "constraint", n AS violations FROM ({_A_ORPHANS} UNION ALL {_A_OTHERS}) o'),
    "constraint_audit_of_sound_tables": _sql(
        _ALL7, f'SELECT constraint_name AS "constraint", n AS violations FROM ({_ORPHANS} UNION ALL {_DUPLICATES} UNION ALL {_LENGTHS}) o'),
    # streaming
    "streamed_vitals": _sql("loaded_vital loaded_encounter", """
        SELECT * FROM loaded_vital WHERE encounter_id IN (SELECT encounter_id FROM loaded_encounter)"""),
    "streamed_hourly_vitals": _sql("hourly vital_sign", f"""
        SELECT encounter_id, hour, {_rounded(V6)} FROM hourly
        WHERE hour + INTERVAL '1' HOUR <= (SELECT MAX(recorded_at) FROM vital_sign WHERE vital_type IN ({_IN6})) - INTERVAL '2' HOUR"""),
    "corrected_hours": _sql("vital_sign", f"""
        SELECT encounter_id, hour, {_rounded(V6)} FROM (
            SELECT encounter_id, date_trunc('hour', recorded_at) AS hour, {_pivot()}
            FROM (SELECT DISTINCT * FROM vital_sign) d WHERE vital_type IN ({_IN6}) GROUP BY 1, 2) h"""),
}
