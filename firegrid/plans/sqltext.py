"""SQL fragments for the checking side: the formulas written out a second time, in SQL."""

from __future__ import annotations

from firegrid.plans.adapters import OUTLINE

E = "0.00669438e0"
_E, _R = 0.00669438, 6378137.0
EP = repr(_E / (1 - _E))
M1 = repr(1 - _E / 4 - 3 * _E**2 / 64 - 5 * _E**3 / 256)
M2 = repr(3 * _E / 8 + 3 * _E**2 / 32 + 45 * _E**3 / 1024)
M3 = repr(15 * _E**2 / 256 + 45 * _E**3 / 1024)
M4 = repr(35 * _E**3 / 3072)


def d(text: str) -> str:
    """A Python float literal as a SQL double."""
    return f"CAST({text} AS DOUBLE)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    u = f"sin((radians({lat2})-radians({lat1}))/2e0)"
    v = f"sin((radians({lon2})-radians({lon1}))/2e0)"
    return (f"12742e0*asin(sqrt(least(1e0,{u}*{u}"
            f"+cos(radians({lat1}))*cos(radians({lat2}))*{v}*{v})))")


def cells(rel: str, km: float = 1, out: str = "grid_id") -> str:
    """``rel`` with the cell id of (latitude, longitude); northern hemisphere, plain zones."""
    side = f"{float(km) * 1000.0}"
    return f"""
SELECT b.* EXCLUDE (zn_, p_, k_, c_, t_, n_, a_, m_, e_, no_),
  CAST(zn_ AS VARCHAR) || substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor((latitude+80e0)/8e0) AS INTEGER)+1, 1)
  || '_' || CAST(CAST(floor(e_/{d(side)}) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(no_/{d(side)}) AS BIGINT) AS VARCHAR) AS {out}
FROM (SELECT a.*,
  0.9996e0*n_*(a_ + a_*a_*a_/6e0*(1e0-t_+c_) + a_*a_*a_*a_*a_/120e0*(5e0-18e0*t_+t_*t_+72e0*c_-58e0*{d(EP)})) + 500000e0 AS e_,
  0.9996e0*(m_ + n_*tan(p_)*(a_*a_/2e0 + a_*a_*a_*a_/24e0*(5e0-t_+9e0*c_+4e0*c_*c_)
    + a_*a_*a_*a_*a_*a_/720e0*(61e0-58e0*t_+t_*t_+600e0*c_-330e0*{d(EP)}))) AS no_
 FROM (SELECT z.*,
   {d(EP)}*cos(p_)*cos(p_) AS c_, tan(p_)*tan(p_) AS t_,
   6378137e0/sqrt(1e0-{E}*sin(p_)*sin(p_)) AS n_,
   cos(p_)*radians(longitude - k_) AS a_,
   6378137e0*({d(M1)}*p_-{d(M2)}*sin(2e0*p_)+{d(M3)}*sin(4e0*p_)-{d(M4)}*sin(6e0*p_)) AS m_
  FROM (SELECT y.*, (zn_-1)*6e0-177e0 AS k_ FROM (SELECT x.*,
     CAST(floor((longitude+180e0)/6e0) AS INTEGER)+1 AS zn_, radians(latitude) AS p_ FROM ({rel}) x) y) z) a) b"""


_e1 = (1 - (1 - _E) ** 0.5) / (1 + (1 - _E) ** 0.5)
P2 = repr(3 * _e1 / 2 - 27 * _e1**3 / 32 + 269 * _e1**5 / 512)
P3 = repr(21 * _e1**2 / 16 - 55 * _e1**4 / 32)
P4 = repr(151 * _e1**3 / 96 - 417 * _e1**5 / 128)
P5 = repr(1097 * _e1**4 / 512)


def centres(rel: str, km: float = 1) -> str:
    """``rel`` with (latitude, longitude) of the centre of ``grid_id``; northern hemisphere."""
    side = float(km) * 1000.0
    return f"""
SELECT h.* EXCLUDE (zn_, x_, y_, u_, p_, t_, q_, n_, r_, c_, d_),
  degrees(p_ - tan(p_)/r_*(d_*d_/2e0 - d_*d_*d_*d_/24e0*(5e0+3e0*t_+10e0*c_-4e0*c_*c_-9e0*{d(EP)}))
    + d_*d_*d_*d_*d_*d_/720e0*(61e0+90e0*t_+298e0*c_+45e0*t_*t_-252e0*{d(EP)}-3e0*c_*c_)) AS latitude,
  degrees((d_ - d_*d_*d_/6e0*(1e0+2e0*t_+c_)
    + d_*d_*d_*d_*d_/120e0*(5e0-2e0*c_+28e0*t_-3e0*c_*c_+8e0*{d(EP)}+24e0*t_*t_))/cos(p_)) + (zn_-1)*6e0-177e0 AS longitude
FROM (SELECT g.*, x_/(n_*0.9996e0) AS d_ FROM (SELECT f.*, 6378137e0/sqrt(q_) AS n_, (1e0-{E})/q_ AS r_,
   {d(EP)}*cos(p_)*cos(p_) AS c_
 FROM (SELECT e.*, tan(p_)*tan(p_) AS t_, 1e0-{E}*sin(p_)*sin(p_) AS q_
 FROM (SELECT c.*, u_+{d(P2)}*sin(2e0*u_)+{d(P3)}*sin(4e0*u_)+{d(P4)}*sin(6e0*u_)+{d(P5)}*sin(8e0*u_) AS p_
 FROM (SELECT b.*, y_/0.9996e0/(6378137e0*{d(M1)}) AS u_
 FROM (SELECT a.*, CAST(regexp_extract(grid_id, '^([0-9]+)', 1) AS INTEGER) AS zn_,
   CAST(split_part(grid_id,'_',2) AS DOUBLE)*{side}e0+{side / 2}e0-500000e0 AS x_,
   CAST(split_part(grid_id,'_',3) AS DOUBLE)*{side}e0+{side / 2}e0 AS y_ FROM ({rel}) a) b) c) e) f) g) h"""


def week(date: str) -> str:
    start = f"CAST(date_trunc('week', {date}) AS DATE)"
    return f"CAST({start} AS VARCHAR) || '/' || CAST({start} + 6 AS VARCHAR)"


def week_start(date: str) -> str:
    return f"CAST(date_trunc('week', {date}) AS DATE)"


EDGES = "(VALUES " + ", ".join(
    f"({a[0]}e0,{a[1]}e0,{b[0]}e0,{b[1]}e0)" for a, b in zip(OUTLINE, OUTLINE[1:] + OUTLINE[:1])
) + ") AS e(x1,y1,x2,y2)"


def inside(lat: str = "latitude", lon: str = "longitude") -> str:
    return (f"(SELECT count(*) FROM {EDGES} WHERE (y1<={lat})<>(y2<={lat})"
            f" AND {lon} < x1+({lat}-y1)/(y2-y1)*(x2-x1)) % 2 = 1")


def lattice(km: float) -> str:
    """Distinct cells of the lattice of step km/111 degrees inside the outline."""
    xs, ys = [p[0] for p in OUTLINE], [p[1] for p in OUTLINE]
    step = km / 111.0
    nx, ny = int((max(xs) - min(xs)) / step) + 1, int((max(ys) - min(ys)) / step) + 1
    points = (f"SELECT CAST({min(ys)!r} AS DOUBLE) + CAST(id//{nx} AS DOUBLE)*CAST({step!r} AS DOUBLE) AS latitude, "
              f"CAST({min(xs)!r} AS DOUBLE) + CAST(id%{nx} AS DOUBLE)*CAST({step!r} AS DOUBLE) AS longitude "
              f"FROM range({nx * ny}) AS g(id)")
    return f"SELECT DISTINCT grid_id FROM ({cells(f'SELECT * FROM ({points}) p WHERE {inside()}', km)}) l"


def bins(rel: str, days: int = 7) -> str:
    """``rel`` with the 7-day ``date_bin`` label."""
    return f"""
SELECT t.*, CAST(t.date - CAST((t.date - s.lo) % {days} AS INTEGER) AS VARCHAR) || '_' ||
  CAST(least(t.date - CAST((t.date - s.lo) % {days} AS INTEGER) + {days - 1}, s.hi) AS VARCHAR) AS date_bin
FROM ({rel}) t, (SELECT min(date) AS lo, max(date) AS hi FROM ({rel}) u) s"""


WEATHER_BINS = bins("SELECT * FROM weather_v")
LOC = "PARTITION BY longitude, latitude, date_bin"


def md5(key: str, seed) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


def sample_skew(x: str) -> str:
    """Sample-corrected skewness from central moments; ``x`` needs no NULLs removed."""
    return f"skewness({x})"


# Fixed values of the inverse normal approximation, as in functions/scalar.py.
def inverse_normal(p: str) -> str:
    from firegrid.functions.scalar import NORM_A, NORM_B, NORM_C, NORM_D, NORM_LOW

    def poly(coeffs, x):
        text = d(repr(coeffs[0]))
        for c in coeffs[1:]:
            text = f"({text}*{x}+{d(repr(c))})"
        return text

    def tail(q):
        return f"{poly(NORM_C, q)}/({poly(NORM_D, q)}*{q}+1e0)"

    low, high = f"sqrt(-2e0*ln({p}))", f"sqrt(-2e0*ln(1e0-{p}))"
    mid, r = f"({p}-0.5e0)", f"(({p}-0.5e0)*({p}-0.5e0))"
    return (f"CASE WHEN {p} < {d(repr(NORM_LOW))} THEN {tail(low)} WHEN {p} > {d(repr(1 - NORM_LOW))} THEN -({tail(high)})"
            f" ELSE {poly(NORM_A, r)}*{mid}/({poly(NORM_B, r)}*{r}+1e0) END")


def yeo_johnson(x: str, lam: str) -> str:
    return (f"CASE WHEN {x} >= 0e0 THEN CASE WHEN abs({lam}) < 1e-9 THEN ln(1e0+{x}) ELSE (pow({x}+1e0,{lam})-1e0)/{lam} END"
            f" ELSE CASE WHEN abs(2e0-{lam}) < 1e-9 THEN -ln(1e0-{x}) ELSE -(pow(1e0-{x},2e0-{lam})-1e0)/(2e0-{lam}) END END")


def best_lambda(long: str, grid: str) -> str:
    """(variable, lam) of largest likelihood; ``grid`` is a relation (v, lam)."""
    return f"""SELECT variable, lam FROM (SELECT variable, lam, -count(*)/2e0*ln(var_pop(y)) + (lam-1e0)*sum(sign(x)*ln(1e0+abs(x))) AS ll
 FROM (SELECT l.variable, l.x, g.lam, {yeo_johnson('l.x', 'g.lam')} AS y FROM ({long}) l JOIN ({grid}) g ON l.variable = g.v) t
 GROUP BY variable, lam HAVING var_pop(y) > 0e0) s QUALIFY row_number() OVER (PARTITION BY variable ORDER BY ll DESC, lam) = 1"""
