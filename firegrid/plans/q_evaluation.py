"""Queries over the evaluation operators, on labels and scores with ties."""

from pyspark.sql import functions as F

from firegrid.operators import evaluation as e
from firegrid.operators.profiling import class_weight, histogram
from firegrid.plans.catalog import query


def counts(by: str = "", where: str = "") -> str:
    """Running counts per distinct score, from the highest score down."""
    keys, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    all_part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {keys}threshold, pos, cnt, sum(pos) OVER ({part}ORDER BY threshold DESC)::DOUBLE AS tp,
 sum(cnt) OVER ({part}ORDER BY threshold DESC)::DOUBLE AS seen, sum(pos) OVER ({all_part})::DOUBLE AS p,
 sum(cnt - pos) OVER ({all_part})::DOUBLE AS n
FROM (SELECT {keys}score AS threshold, sum(label) AS pos, count(*) AS cnt FROM score_v {where} GROUP BY {keys}score) g"""


F1 = "2e0*(tp/seen)*(tp/p)/((tp/seen)+(tp/p)+1e-8)"


def best(where: str = "") -> str:
    return f"SELECT threshold, {F1} AS f1 FROM ({counts(where=where)}) c ORDER BY f1 DESC, threshold LIMIT 1"


def areas(by: str) -> str:
    return f"""SELECT {by}, sum((cnt-pos)*((tp-pos)+pos/2e0)/(p*n)) AS roc_auc, sum(pos/p*(tp/seen)) AS average_precision,
 sum(pos/p*((tp/seen) + CASE WHEN seen=cnt THEN 1e0 ELSE (tp-pos)/(seen-cnt) END)/2e0) AS pr_auc
FROM ({counts(by)}) c GROUP BY {by}"""


def matrix(cut: str, by: str = "", rel: str = "score_v") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}count(*) FILTER (WHERE label=0 AND score<{cut}) AS tn, count(*) FILTER (WHERE label=0 AND score>={cut}) AS fp,
 count(*) FILTER (WHERE label=1 AND score<{cut}) AS fn, count(*) FILTER (WHERE label=1 AND score>={cut}) AS tp FROM {rel} {group}"""


METRICS = """(tp+tn)/CAST(tn+fp+fn+tp AS DOUBLE) AS accuracy, coalesce(tp/nullif(CAST(tp+fp AS DOUBLE),0e0),0e0) AS precision,
 coalesce(tp/nullif(CAST(tp+fn AS DOUBLE),0e0),0e0) AS recall, coalesce(2e0*tp/nullif(CAST(2*tp+fp+fn AS DOUBLE),0e0),0e0) AS f1"""
CUT = f"(SELECT threshold FROM ({best()}) b)"


@query("pr_curve", "threshold:r precision:r recall:r",
       f"SELECT threshold, tp/seen AS precision, tp/p AS recall FROM ({counts()}) c UNION ALL SELECT NULL, 1e0, 0e0")
def _(t):
    return e.pr_curve(t.scores())


@query("best_threshold", "threshold:r f1:r", best())
def _(t):
    return e.best_threshold(t.scores())


def _cut(scores):
    return e.best_threshold(scores).select("threshold").scalar()


@query("confusion", "tn:i fp:i fn:i tp:i", matrix(CUT))
def _(t):
    return e.confusion(t.scores(), _cut(t.scores()))


@query("class_metrics", "tn:i fp:i fn:i tp:i accuracy:r precision:r recall:r f1:r", f"SELECT m.*, {METRICS} FROM ({matrix(CUT)}) m")
def _(t):
    return e.class_metrics(e.confusion(t.scores(), _cut(t.scores())))


@query("roc_curve", "threshold:r fpr:r tpr:r",
       f"SELECT threshold, (seen-tp)/n AS fpr, tp/p AS tpr FROM ({counts()}) c UNION ALL SELECT NULL, 0e0, 0e0")
def _(t):
    return e.roc_curve(t.scores())


@query("roc_auc", "split roc_auc:r", areas("split"))
def _(t):
    return e.curve_areas(t.scores(), ["split"])


@query("average_precision", "split average_precision:r", areas("split"))
def _(t):
    return e.curve_areas(t.scores(), ["split"])


BEST_TEST = best("WHERE split = 'test'")
M = "accuracy precision recall f1 roc_auc average_precision".split()
PIVOT = ", ".join(f"max({c}) FILTER (WHERE split='{s}') AS {pre}{c}"
                  for s, pre in (("test", ""), ("train", "train_"), ("val", "val_")) for c in M)
GAPS = """train_accuracy - accuracy AS train_test_accuracy_gap, train_roc_auc - roc_auc AS train_test_roc_auc_gap,
 train_accuracy - val_accuracy AS train_val_accuracy_gap, val_accuracy - accuracy AS val_test_accuracy_gap"""


@query("overfit_gaps", " ".join(f"{pre}{c}:r" for pre in ("", "train_", "val_") for c in M)
       + " threshold_used:r train_test_accuracy_gap:r train_test_roc_auc_gap:r train_val_accuracy_gap:r val_test_accuracy_gap:r", f"""
SELECT w.*, {GAPS} FROM (SELECT {PIVOT}, (SELECT threshold FROM ({BEST_TEST}) b) AS threshold_used
 FROM (SELECT m.*, {METRICS} FROM ({matrix(f'(SELECT threshold FROM ({BEST_TEST}) b)', 'split')}) m) x
 JOIN ({areas('split')}) a USING (split)) w""")
def _(t):
    return e.overfit_gaps(t.scores())


def _gap_sql(cut: str) -> str:
    """The one-row metrics for a threshold that may depend on the split."""
    return f"""
SELECT w.*, {GAPS} FROM (SELECT {PIVOT}, max(cut) FILTER (WHERE split='test') AS threshold_used,
  max(CAST(tn AS VARCHAR) || ',' || CAST(fp AS VARCHAR) || ',' || CAST(fn AS VARCHAR) || ',' || CAST(tp AS VARCHAR)) FILTER (WHERE split='test') AS matrix
 FROM (SELECT m.*, {METRICS} FROM (SELECT split, cut, count(*) FILTER (WHERE label=0 AND score<cut) AS tn, count(*) FILTER (WHERE label=0 AND score>=cut) AS fp,
   count(*) FILTER (WHERE label=1 AND score<cut) AS fn, count(*) FILTER (WHERE label=1 AND score>=cut) AS tp
   FROM (SELECT s.*, {cut} AS cut FROM score_v s) c GROUP BY split, cut) m) x JOIN ({areas('split')}) a USING (split)) w"""


GAP_COLUMNS = (" ".join(f"{pre}{c}:r" for pre in ("", "train_", "val_") for c in M) + " threshold_used:r matrix"
               " train_test_accuracy_gap:r train_test_roc_auc_gap:r train_val_accuracy_gap:r val_test_accuracy_gap:r")


def _flat(metrics):
    return metrics.withColumn("matrix", F.concat_ws(",", F.flatten("confusion_matrix")))


@query("metrics_given", GAP_COLUMNS, _gap_sql("0.4e0"))
def _(t):
    return _flat(e.overfit_gaps(t.scores(), "given", threshold=0.4))


@query("metrics_standalone", GAP_COLUMNS, _gap_sql(f"CASE WHEN s.split='test' THEN (SELECT threshold FROM ({BEST_TEST}) b) ELSE 0.5e0 END"))
def _(t):
    return _flat(e.overfit_gaps(t.scores(), "standalone"))


@query("metrics_best", GAP_COLUMNS, _gap_sql("CASE s.split " + " ".join(
    f"WHEN '{x}' THEN (SELECT threshold FROM ({best(f'WHERE split = {chr(39)}{x}{chr(39)}')}) b_{x})" for x in ("train", "val", "test")) + " END"))
def _(t):
    return _flat(e.overfit_gaps(t.scores(), "best"))


def _line(name: str, hit: str, wrong: str, missed: str) -> str:
    return (f"SELECT '{name}' AS class, {hit}/CAST({hit}+{wrong} AS DOUBLE) AS precision, {hit}/CAST({hit}+{missed} AS DOUBLE) AS recall, "
            f"2e0*{hit}/(2*{hit}+{wrong}+{missed}) AS f1, {hit}+{missed} AS support FROM m")


@query("classification_report", "class precision:r recall:r f1:r support:i", f"""
WITH m AS ({matrix(CUT)}), two AS ({_line('0', 'tn', 'fn', 'fp')} UNION ALL {_line('1', 'tp', 'fp', 'fn')})
SELECT * FROM two UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT (tp+tn)/CAST(tn+fp+fn+tp AS DOUBLE) AS a, tn+fp+fn+tp AS n FROM m) x
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM two
UNION ALL SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support), sum(support) FROM two""")
def _(t):
    return e.classification_report(e.confusion(t.scores(), _cut(t.scores())))


@query("model_comparison", "model roc_auc:r average_precision:r",
       f"SELECT model, roc_auc, pr_auc AS average_precision FROM ({areas('model')}) a")
def _(t):
    return e.model_comparison(t.scores())


@query("score_histogram", "label:i bin:i n:i bin_start:r bin_end:r", """
SELECT label, bin, count(*) AS n, min(lo + bin*w) AS bin_start, min(lo + (bin+1)*w) AS bin_end
FROM (SELECT label, lo, w, CAST(least(floor((score-lo)/w), 19e0) AS INTEGER) AS bin FROM score_v,
 (SELECT min(score) AS lo, (max(score)-min(score))/20e0 AS w FROM score_v) b) s GROUP BY label, bin""")
def _(t):
    return histogram(t.scores(), "score", 20, ["label"])


@query("class_weight", "n_negative:i n_positive:i scale_pos_weight:r", """
SELECT count(*) FILTER (WHERE label=0) AS n_negative, count(*) FILTER (WHERE label=1) AS n_positive,
 count(*) FILTER (WHERE label=0) / CAST(count(*) FILTER (WHERE label=1) AS DOUBLE) AS scale_pos_weight FROM score_v""")
def _(t):
    return class_weight(t.scores())


@query("score_summary", "total_rows:i predicted_fires:i",
       "SELECT count(*) AS total_rows, sum(CASE WHEN score >= 0.5e0 THEN 1 ELSE 0 END) AS predicted_fires FROM score_v")
def _(t):
    from firegrid.operators.modelling import score_summary
    return score_summary(t.scores().withColumn("fire_predicted", (F.col("score") >= 0.5).cast("int")))
