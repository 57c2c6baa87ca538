"""DuckDB SQL that states each query independently, for the side-by-side check.

Written the direct way, e.g. anchored VWAPs as joins over date ranges and averages as
sliding frames, so that it does not repeat how the Spark side gets its results.
"""

from __future__ import annotations

from gapscan.functions import buckets
from gapscan.functions.buckets import Buckets
from gapscan.plans.reports import ABOVE_BELOW_LEVELS
from gapscan.schema import OUTCOME_COLUMNS, QUARTER_ANCHORS

HORIZONS = (5, 10)

BARS = """
t as (select l_suppkey k, cast(l_shipdate as date) d, cast(round(l_extendedprice*100) as bigint) e,
             cast(round(l_quantity) as bigint) v from lineitem),
m as (select *, cast(year(d)*6 + (month(d)-1)//2 as bigint) ym from t),
b as (select *, 5000 + ((k*7919 + ym*(104729 + k*97) + ym*ym*331) % 2500) lvl from m),
p as (select 'S'||k symbol, d, lvl + e%400 o, lvl + (e//7)%400 c, e, v from b),
candle as (
  select symbol, d as date, o/100.0::double as open, (greatest(o,c)+e%97)/100.0::double as high,
         (least(o,c)-e%89)/100.0::double as low, c/100.0::double as close, v as volume from p
  union all
  select 'SPY', d, (40000+s%2000)/100.0::double, 420.0::double, 400.0::double,
         (40000+(s//7)%2000)/100.0::double, n
  from (select d, cast(sum(e) as bigint) s, count(*) n from t group by d)),
bar as materialized (select symbol, date, open, high, low, close, volume from candle qualify row_number() over (
  partition by symbol, date order by coalesce(volume,0) desc, open desc, close desc, high desc, low desc) = 1),
prev as materialized (select *, lag(close) over (partition by symbol order by date) prev_close,
                row_number() over (partition by symbol order by date) rn from bar)
"""


def vwap(frame: str = "") -> str:
    """VWAP with whole-number sums of price millionths."""
    tp = "cast(round((high+low+close)*1000000) as hugeint)"
    tpv, vol = f"sum({tp}*volume){frame}", f"sum(volume){frame}"
    return (
        f"case when {vol} > 0 then cast({tpv} as double)/(cast({vol} as double)*3000000.0::double)"
        f" else cast(sum({tp}){frame} as double)/(count({tp}){frame}*3000000.0::double) end"
    )


NEAR = f"""
near as materialized (select *, {vwap(" over (partition by symbol order by date range between interval 3 days preceding and current row)")}
         anchored_vwap from prev)
"""


def gaps(mode: str) -> str:
    size = "(open-prev_close)/prev_close" if mode == "up" else "(prev_close-open)/prev_close"
    room = "open-anchored_vwap" if mode == "up" else "anchored_vwap-open"
    return f"""
gap_{mode} as (select *, {size} gap_percent from near where prev_close between 20 and 1000 and {size} >= 0.02::double),
room_{mode} as (select * from gap_{mode} where {room} > 0 and {room} >= 0.02::double*prev_close),
fwd_{mode} as (select g.*, n.rn - g.rn k, n.date fdate, n.high fhigh, n.low flow
  from room_{mode} g join prev n on n.symbol = g.symbol and n.rn between g.rn+1 and g.rn+10)
"""


def sma(n: int, min_bars: int, extra: str = "") -> str:
    frame = f"over (partition by symbol order by date rows between {n - 1} preceding and current row)"
    mean = f"(cast(sum(cast(round(close*1000000) as bigint)) {frame} as double)/(count(close) {frame}*1000000.0::double))"
    return (
        f"case when count(*) over (partition by symbol order by date rows between unbounded preceding and current row)"
        f" >= {min_bars}{extra} and {mean} > 0 then (close-{mean})/{mean}*100.0::double end"
    )


EMA = """
ema as (select *, case when len(closes) >= 21 then list_reduce(closes,
    lambda acc, x: acc*0.9090909090909091::double + x*0.09090909090909091::double) end ema_21
  from (select *, list(close) over (partition by symbol order by date rows between 49 preceding and current row) closes
        from prev))
"""


def anchored(table: str, alias: str) -> str:
    """VWAP distances from the quarter anchors, by a join of each row with all bars since its earliest anchor."""
    tp = "cast(round((b.high+b.low+b.close)*1000000) as hugeint)"
    sums = []
    for name, back in QUARTER_ANCHORS.items():
        since = f"filter (b.date >= cast(date_trunc('quarter', a.date) as date) - {back})"
        tpv, vol = f"sum({tp}*b.volume) {since}", f"sum(b.volume) {since}"
        sums.append(
            f"case when {vol} > 0 then cast({tpv} as double)/(cast({vol} as double)*3000000.0::double)"
            f" else cast(sum({tp}) {since} as double)/(count({tp}) {since}*3000000.0::double) end w_{name}"
        )
    distances = ", ".join(
        f"case when w_{name} > 0 then (close-w_{name})/w_{name}*100.0::double end avwap_{name}_distance_percent"
        for name in QUARTER_ANCHORS
    )
    return f"""
{alias} as (select symbol, date, close, {distances} from (
  select a.symbol, a.date, any_value(a.close) as close, {", ".join(sums)}
  from {table} a join bar b on b.symbol = a.symbol and b.date <= a.date
       and b.date >= cast(date_trunc('quarter', a.date) as date) - 365
  group by a.symbol, a.date))
"""


SPY = """
spy as (select date, (close-prev_close)/prev_close*100 spy_daily_gain_percent
        from prev where symbol = 'SPY' and prev_close is not null)
"""


def extremes(mode: str) -> str:
    columns = ", ".join(
        f"min(flow) filter (k <= {h}) lowest_{h}d, max(fhigh) filter (k <= {h}) highest_{h}d" for h in HORIZONS
    )
    hit = "flow <= anchored_vwap" if mode == "up" else "fhigh >= anchored_vwap"
    touches = ", ".join(
        f"cast(min(k) filter (k <= {h} and {hit}) as int) days_to_retrace_{h}d" for h in HORIZONS
    )
    return f"""
ext_{mode} as (select g.*, lowest_5d, highest_5d, lowest_10d, highest_10d, days_to_retrace_5d, days_to_retrace_10d
  from room_{mode} g left join (select symbol, date, {columns}, {touches} from fwd_{mode} group by symbol, date) f
  using (symbol, date))
"""


def ema_touch(mode: str) -> str:
    hit = "flow <= ema_21" if mode == "up" else "fhigh >= ema_21"
    touches = ", ".join(
        f"cast(min(k) filter (fdate <= f.date + {h} and {hit}) as int) days_to_21ema_{h}d" for h in HORIZONS
    )
    return f"""
touch_{mode} as (select g.symbol, g.date, e.ema_21, days_to_21ema_5d, days_to_21ema_10d
  from room_{mode} g join ema e using (symbol, date)
  left join (select f.symbol, f.date, {touches} from fwd_{mode} f join ema e2 using (symbol, date)
             group by f.symbol, f.date) h on h.symbol = g.symbol and h.date = g.date)
"""


def excursions(h: int) -> str:
    return (
        f"case when close > 0 then coalesce(highest_{h}d-close, 0) else 0 end mfe_dollars_{h}d,"
        f"case when close > 0 then coalesce(close-lowest_{h}d, 0) else 0 end mae_dollars_{h}d,"
        f"case when close > 0 then coalesce((highest_{h}d-close)/close*100, 0) else 0 end mfe_percent_{h}d,"
        f"case when close > 0 then coalesce((close-lowest_{h}d)/close*100, 0) else 0 end mae_percent_{h}d"
    )


def moved(mode: str, h: int) -> str:
    return f"open-lowest_{h}d" if mode == "up" else f"highest_{h}d-open"


def retrace(mode: str, h: int) -> str:
    way = "(open-anchored_vwap)" if mode == "up" else "(anchored_vwap-open)"
    back = moved(mode, h)
    return (
        f"case when anchored_vwap > 0 and {way} > 0 and {back} is not null"
        f" then greatest(0.0::double, {back})/{way}*100 else 0.0::double end retrace_percentage_{h}d"
    )


def closure(mode: str, h: int) -> str:
    back = moved(mode, h)
    filled = f"lowest_{h}d <= prev_close" if mode == "up" else f"highest_{h}d >= prev_close"
    return (
        f"case when abs(open-prev_close) > 0 and {back} is not null"
        f" then greatest(0.0::double, {back})/abs(open-prev_close)*100 else 0.0::double end gap_closure_percentage_{h}d,"
        f"coalesce(abs(open-prev_close) > 0 and {filled}, false) gap_filled_{h}d"
    )


def outcome(mode: str) -> str:
    order = ", ".join(OUTCOME_COLUMNS)
    horizon = ", ".join(
        f"days_to_retrace_{h}d is not null retraced_to_vwap_{h}d, days_to_retrace_{h}d, {retrace(mode, h)},"
        f"{closure(mode, h)}, {excursions(h)}, days_to_21ema_{h}d is not null retraced_to_21ema_{h}d, days_to_21ema_{h}d"
        for h in HORIZONS
    )
    averages = ", ".join(f"sma_{n}_distance_percent" for n in (21, 50, 100, 200, 330))
    anchors = ", ".join(f"avwap_{name}_distance_percent" for name in QUARTER_ANCHORS)
    direction = "short" if mode == "up" else "long"
    return f"""
{extremes(mode)}, {ema_touch(mode)}, {anchored(f"room_{mode}", f"anch_{mode}")},
outcome_{mode} as (select {order}, '{direction}' direction from (
  select e.symbol ticker, e.date, gap_percent*100 gap_up_percent, open open_price, e.close close_price, anchored_vwap,
         {horizon.replace("close >", "e.close >").replace("-close", "-e.close").replace("/close", "/e.close")
                 .replace("(close-", "(e.close-")}, ema_21, {averages}, {anchors}, spy_daily_gain_percent
  from ext_{mode} e join touch_{mode} u using (symbol, date) join sma_all s using (symbol, date)
       join anch_{mode} a using (symbol, date) left join spy using (date)))
"""


SMA_ALL = "sma_all as (select symbol, date, {} from bar)".format(", ".join(
    f"{sma(n, n if n != 330 else 1)} sma_{n}_distance_percent" for n in (21, 50, 100, 200, 330)
))


def two_decimals(x: str) -> str:
    """Half-up rounding of the shortest decimal text of a double."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38,15)), 2) as double)"


def rounded(mode: str) -> str:
    columns = ", ".join(
        f"{two_decimals(name)} {name}" if kind == "double" else name for name, kind in OUTCOME_COLUMNS.items()
    )
    return f"pub_{mode} as (select {columns}, direction from outcome_{mode})"


def base(*modes: str) -> str:
    return ",".join([BARS, NEAR, *[gaps(m) for m in modes]])


def full(*modes: str) -> str:
    return ",".join([base(*modes), EMA, SPY, SMA_ALL, *[outcome(m) for m in modes], *[rounded(m) for m in modes]])


def bar_query(select: str, *ctes: str) -> str:
    return f"with {','.join([BARS, NEAR, *ctes])} {select}"


def gap_query(select: str, *ctes: str) -> str:
    """With the modes that the statement speaks of, and no others."""
    text = " ".join([select, *ctes])
    return f"with {','.join([base(*[m for m in ('up', 'down') if f'_{m}' in text]), *ctes])} {select}"


def report_query(select: str, *ctes: str, mode: str = "up") -> str:
    """Statements speak of the up gaps; for down gaps they are put to those."""
    said = ",".join([full(mode), *[c.replace("pub_up", f"pub_{mode}") for c in ctes]])
    return f"with {said} {select.replace('pub_up', f'pub_{mode}')}"


def rate(condition: str) -> str:
    return f"avg(coalesce(cast({condition} as int), 0))*100"


def infinite_ratio(profit: str, loss: str) -> str:
    return (
        f"case when {loss} > 0 then {two_decimals(f'({profit})/({loss})')}"
        f" when {profit} > 0 then 'infinity'::double end"
    )


def fraction_pf(h: int) -> str:
    fraction = f"coalesce(least(greatest(retrace_percentage_{h}d/100, 0.0::double), 1.0::double), 0.0::double)"
    total = "cast(sum(cast({} as decimal(26,8))) as double)"
    return infinite_ratio(total.format(fraction), total.format(f"1-{fraction}"))


def win_pf(condition: str) -> str:
    wins = f"sum(coalesce(cast({condition} as int), 0))"
    return infinite_ratio(f"cast({wins} as double)", f"cast(count(*)-{wins} as double)")


def performance(h: int) -> str:
    return (
        f"count(*) trades, {two_decimals(rate(f'retraced_to_vwap_{h}d'))} avwap_rate, {fraction_pf(h)} avwap_pf,"
        f"{two_decimals(rate(f'gap_filled_{h}d'))} gap_close_rate, {win_pf(f'gap_filled_{h}d')} gap_close_pf,"
        f"{two_decimals(rate(f'retraced_to_21ema_{h}d'))} ema21_rate, {win_pf(f'retraced_to_21ema_{h}d')} ema21_pf"
    )


def bucket_table(which: Buckets, value: str, measures: str, columns: str, table: str = "pub_up", mode: str = "up") -> str:
    """Measures per bucket, empty buckets kept."""
    rows = ", ".join(
        f"({i}, {low}::double, {high}::double, '{label}')"
        for i, (low, high, label) in enumerate(zip(which.edges, which.edges[1:], which.labels))
    )
    return report_query(
        f"""select dim.bucket_no, dim.bucket, {columns} from dim left join (
          select bucket_no, {measures} from (select *, {value} val from {table}) x
          join dim on val >= lo and val < hi group by bucket_no) y on y.bucket_no = dim.bucket_no""",
        f"dim as (select cast(a as int) bucket_no, lo, hi, bucket from (values {rows}) v(a, lo, hi, bucket))",
        mode=mode,
    )


def win_table(which: Buckets, value: str, h: int, mode: str = "up") -> str:
    return bucket_table(which, value, f"{rate(f'retraced_to_vwap_{h}d')} rate", "y.rate", mode=mode)


def pnl(h: int) -> str:
    fraction = f"least(greatest(retrace_percentage_{h}d/100, 0.0::double), 1.0::double)"
    earned = (
        f"(case when open_price > 0 then 10000.0::double/open_price else 0.0::double end"
        f"*abs(anchored_vwap-open_price)*({fraction}*2-1))"
    )
    return f"case when retrace_percentage_{h}d is not null then least(greatest({earned}, -600.0::double), 1200.0::double) end"


PNL = f"trade as (select ticker, date, {pnl(5)} pnl_5, {pnl(10)} pnl_10 from pub_up)"


def above_below(levels: dict[str, str]) -> str:
    parts = [
        f"select '{level}' as level, case when {column} >= 0 then 'Above' else 'Below' end side, '{h}d' horizon,"
        f" cast(sum(coalesce(cast(retraced_to_vwap_{h}d as int), 0)) as double)/count(*)*100 rate"
        f" from pub_up where {column} is not null group by 1, 2"
        for level, column in levels.items()
        for h in HORIZONS
    ]
    return report_query(" union all ".join(parts))


MONTHS = f"""
months as (select cast(date_trunc('month', date) as date) as month, count(ticker) total,
  cast(sum(cast(retraced_to_vwap_5d as int)) as bigint) retraced5,
  cast(sum(cast(retraced_to_vwap_10d as int)) as bigint) retraced10,
  {rate('retraced_to_vwap_5d')} win5, {rate('retraced_to_vwap_10d')} win10 from pub_up group by 1)
"""

EVENTS = """
ev as (select event_id, user_id, event_type, ts, cast(floor(value/20) as bigint) as level, cast(ts as date) as day
       from events),
chg as (select * from ev window w as (partition by user_id, event_type order by ts, event_id)
        qualify row_number() over w = 1 or level is distinct from lag(level) over w)
"""

RULE = r"'([^{]+)\{([^}]+)\}'"
SPACE = r"E' \t\n\r\f\x0b'"


def rules(source: str, id: str, text: str) -> str:
    """Declarations of the rules in a text column."""
    return f"""
found as (select {id}, unnest(regexp_extract_all({text}, {RULE}, 1)) sel, unnest(regexp_extract_all({text}, {RULE}, 2)) body,
                 unnest(range(len(regexp_extract_all({text}, {RULE}, 1)))) pos from {source}),
cut as (select {id}, pos, trim(sel, {SPACE}) selector, regexp_split_to_array(trim(body, {SPACE}), ';\\s*') parts from found),
decl as (select {id}, pos, selector, unnest(parts) part, unnest(range(len(parts))) declaration_pos from cut),
rule as (select {id}, cast(pos as int) pos, selector, cast(declaration_pos as int) declaration_pos,
  trim(substr(part, 1, instr(part, ':')-1), {SPACE}) attribute, trim(substr(part, instr(part, ':')+1), {SPACE}) as value
  from decl where contains(part, ':'))
"""


def statements() -> dict[str, str]:
    result = {
        "candles_raw": bar_query("select * from candle"),
        "candles_dedup": bar_query("select * from bar"),
        "trading_dates": bar_query("select distinct date from candle"),
        "prev_close": bar_query("select * exclude (rn) from prev where prev_close is not null"),
        "top_gaps_per_date": gap_query(
            "select * exclude (rn), cast(row_number() over (partition by date order by gap_percent desc, symbol) as int) as rank"
            " from room_up qualify rank <= 5"
        ),
        "candles_of_gap_symbols": gap_query("select * from candle where symbol in (select symbol from room_up)"),
        "vwap_by_symbol": bar_query(f"select symbol, {vwap()} vwap from bar group by symbol"),
        "avwap_3d": bar_query("select symbol, date, anchored_vwap from near"),
        "sma_distances": bar_query(
            "select symbol, date, close, {} from bar".format(
                ", ".join(f"{sma(n, n)} sma_{n}_distance_percent" for n in (21, 50, 100, 200))
            )
        ),
        "sma_330_distance": bar_query(f"select symbol, date, {sma(330, 1)} sma_330_distance_percent from bar"),
        "sma_330_strict": bar_query(
            "select symbol, date, {} sma_330_distance_percent from bar".format(
                sma(330, 330, " and count(*) over (partition by symbol order by date"
                              " range between interval 500 days preceding and current row) >= 330")
            )
        ),
        "ema_21": bar_query("select symbol, date, ema_21 from ema", EMA),
        "avwap_anchors": bar_query("select distinct date, {} from candle".format(", ".join(
            f"cast(date_trunc('quarter', date) as date) - {back} anchor_{name}" for name, back in QUARTER_ANCHORS.items()
        ))),
        "avwap_quarterly": bar_query("select * from every", anchored("bar", "every")),
        "benchmark_gain": gap_query(
            "select symbol, date, spy_daily_gain_percent from room_up left join spy using (date)", SPY
        ),
        "forward_bars": gap_query(
            "select symbol, date, cast(k as int) rn, fdate forward_date, fhigh high, flow low from fwd_up"
        ),
        "forward_extremes": gap_query(
            "select symbol, date, lowest_5d, highest_5d, lowest_10d, highest_10d from ext_up", extremes("up")
        ),
        "retrace_vwap": gap_query(
            " union all ".join(
                f"select '{m}' as mode, symbol, date, anchored_vwap, " + ", ".join(
                    f"days_to_retrace_{h}d is not null retraced_to_vwap_{h}d, days_to_retrace_{h}d" for h in HORIZONS
                ) + f" from ext_{m}" for m in ("up", "down")
            ),
            extremes("up"), extremes("down"),
        ),
        "retrace_ema21": gap_query(
            "select symbol, date, ema_21, " + ", ".join(
                f"days_to_21ema_{h}d is not null retraced_to_21ema_{h}d, days_to_21ema_{h}d" for h in HORIZONS
            ) + " from touch_up", EMA, ema_touch("up"),
        ),
        "mfe_mae": gap_query(f"select symbol, date, {excursions(5)}, {excursions(10)} from ext_up", extremes("up")),
        "retrace_percent": gap_query(
            f"select symbol, date, {retrace('up', 5)}, {retrace('up', 10)} from ext_up", extremes("up")
        ),
        "gap_closure": gap_query(
            f"select symbol, date, {closure('up', 5)}, {closure('up', 10)} from ext_up", extremes("up")
        ),
        "retrace_calendar_10d": gap_query("""
            select symbol, date, waited is not null retraced, cast(waited as int) days_to_retrace,
                   case when open > anchored_vwap and low10 is not null
                        then (open-low10)/(open-anchored_vwap)*100 else 0.0::double end retrace_percentage
            from room_up g left join (select symbol, date, min(flow) low10,
                 min(date_diff('day', date, fdate)) filter (flow <= anchored_vwap) waited
                 from fwd_up where fdate <= date + 10 group by symbol, date) f using (symbol, date)"""),
        "mfe_mae_calendar_10d": gap_query("""
            select symbol, date, coalesce(hi-close, 0) mfe_dollars, coalesce(close-lo, 0) mae_dollars,
                   case when close > 0 then coalesce((hi-close)/close*100, 0) else 0 end mfe_percent,
                   case when close > 0 then coalesce((close-lo)/close*100, 0) else 0 end mae_percent
            from room_up left join (select symbol, date, min(flow) lo, max(fhigh) hi
                 from fwd_up where fdate <= date + 10 group by symbol, date) f using (symbol, date)"""),
    }
    for mode in ("up", "down"):
        result[f"gaps_{mode}"] = gap_query(f"select * exclude (rn, anchored_vwap) from gap_{mode}")
        result[f"gaps_room_{mode}"] = gap_query(f"select * exclude (rn) from room_{mode}")
        result[f"gap_outcomes_{mode}"] = f"with {full(mode)} select * from outcome_{mode}"
    result["outcomes_published"] = (
        f"with {full('up', 'down')} select * from pub_up union all select * from pub_down"
    )
    result["outcomes_csv_roundtrip"] = report_query("select * from pub_up")
    kept = {name: kind for name, kind in OUTCOME_COLUMNS.items()}
    result["outcomes_normalized"] = report_query("select {}, direction from pub_up".format(", ".join(
        f"cast(null as {kind}) {name}" if name in ("ema_21", "spy_daily_gain_percent") else name
        for name, kind in kept.items()
    )))

    by_date = """select d.date, coalesce(n, 0) total_gap_ups, coalesce(r5, 0) retraced_to_vwap_5d,
      case when n > 0 then cast(r5 as double)/n*100 else 0.0::double end retracement_rate_5d,
      coalesce(r10, 0) retraced_to_vwap, case when n > 0 then cast(r10 as double)/n*100 else 0.0::double end retracement_rate
      from (select distinct date from candle) d left join (select date, count(*) n,
        cast(sum(cast(retraced_to_vwap_5d as int)) as bigint) r5, cast(sum(cast(retraced_to_vwap_10d as int)) as bigint) r10
        from outcome_up group by date) o using (date)"""
    result["summary_by_date"] = report_query(by_date)
    result["summary_overall"] = report_query("""select n total_gap_ups, r5 retraced_to_vwap_5d,
      cast(r5 as double)/n*100 overall_rate_5d, r10 retraced_to_vwap, cast(r10 as double)/n*100 overall_rate_10d
      from (select count(*) n, cast(sum(cast(retraced_to_vwap_5d as int)) as bigint) r5,
            cast(sum(cast(retraced_to_vwap_10d as int)) as bigint) r10 from outcome_up)""")

    result["report_header"] = report_query(
        "select count(*) row_count, count(distinct date) date_count, max(direction) direction from pub_up"
    )
    result["overall_rates"] = report_query("select {} from pub_up".format(", ".join(
        f"{two_decimals(rate(f'{condition}_{h}d'))} {name}_rate_{h}d"
        for name, condition in (("avwap", "retraced_to_vwap"), ("ema21", "retraced_to_21ema"), ("gap_fill", "gap_filled"))
        for h in HORIZONS
    )))
    result["profit_factor_overall"] = report_query(
        f"select coalesce({fraction_pf(5)}, 0) profit_factor_5d, coalesce({fraction_pf(10)}, 0) profit_factor_10d from pub_up"
    )
    measured = "y.avwap_rate, y.avwap_pf, y.gap_close_rate, y.gap_close_pf, y.ema21_rate, y.ema21_pf"
    for h in HORIZONS:
        result[f"perf_by_year_{h}d"] = report_query(
            f"select cast(year(date) as int) as year, {performance(h)} from pub_up where date is not null group by 1"
        )
        result[f"perf_by_gap_size_{h}d"] = bucket_table(
            buckets.GAP_SIZE, "gap_up_percent", performance(h), f"coalesce(y.trades, 0) trades, {measured}"
        )
        result[f"monthly_win_{h}d"] = report_query(
            f"""select month, win{h} rate, avg(win{h}) over (order by month rows between 13 preceding and current row) ma14
            from months""", MONTHS
        )
        result[f"win_by_gap_{h}d"] = win_table(buckets.GAP_WIDE, "gap_up_percent", h)
        result[f"win_by_avwap_distance_{h}d"] = win_table(
            buckets.AVWAP_DISTANCE, "greatest(0.0::double, (open_price-anchored_vwap)*100/open_price)", h
        )
        result[f"win_by_sma330_{h}d"] = win_table(buckets.SMA_DISTANCE, "sma_330_distance_percent", h)
        result[f"win_by_benchmark_{h}d"] = win_table(buckets.BENCHMARK_CHANGE, "spy_daily_gain_percent", h)
        result[f"days_to_retrace_{h}d"] = report_query(
            f"""select days_to_retrace_{h}d as day, count(*) as count, cast(count(*) as double)/sum(count(*)) over ()*100 percentage
            from pub_up where retraced_to_vwap_{h}d and days_to_retrace_{h}d is not null group by 1"""
        )
    result["monthly_sma5"] = report_query(
        """select month, total, retraced5, retraced10, r5 rate5, r10 rate10,
           avg(r5) over (order by month rows between 4 preceding and current row) sma5,
           avg(r10) over (order by month rows between 4 preceding and current row) sma10
           from (select *, retraced5*100/total::double r5, retraced10*100/total::double r10 from months)""", MONTHS
    )
    result["monthly_win_both"] = report_query(
        "select month, '5d' horizon, win5 rate from months union all select month, '10d', win10 from months", MONTHS
    )
    result["gap_histogram"] = report_query(
        """select cast(i as int) bin, lo + (i-1)*((hi-lo)/40) bin_low, lo + i*((hi-lo)/40) bin_high, coalesce(n, 0) as count
        from (select min(gap_up_percent) lo, max(gap_up_percent) hi from pub_up), range(1, 41) r(i)
        left join (select bin, count(*) n from (select least(floor(40*(gap_up_percent-lo)/(hi-lo)) + 1, 40) bin
             from pub_up, (select min(gap_up_percent) lo, max(gap_up_percent) hi from pub_up)) group by bin) on bin = i"""
    )
    result["gap_box"] = report_query(
        """select min(gap_up_percent) lowest, quantile_cont(gap_up_percent, 0.25) lower_quartile,
        quantile_cont(gap_up_percent, 0.5) median, quantile_cont(gap_up_percent, 0.75) upper_quartile,
        max(gap_up_percent) highest from pub_up"""
    )
    result["retrace_by_gap_bucket"] = bucket_table(
        buckets.GAP_WIDE, "gap_up_percent", "count(ticker) total, avg(cast(retraced_to_vwap_10d as int))*100 rate10",
        "coalesce(y.total, 0) total, y.rate10",
    )
    result["win_above_below"] = above_below(ABOVE_BELOW_LEVELS)
    result["win_above_below_330"] = above_below({"330-SMA": "sma_330_distance_percent"})
    result["trade_pnl"] = report_query("select * from trade", PNL)
    result["pnl_totals"] = report_query(
        """select cast(sum(cast(pnl_5 as decimal(18,6))) as double) total_pnl_5d,
        cast(sum(cast(pnl_10 as decimal(18,6))) as double) total_pnl_10d from trade""", PNL
    )
    result["equity_curve"] = report_query(
        """select horizon, date, ticker, cast(sum(coalesce(cast(pnl as decimal(18,6)), 0)) over (partition by horizon
             order by date nulls last, ticker rows between unbounded preceding and current row)
             as double) equity
        from (select '5d' horizon, date, ticker, pnl_5 pnl from trade
              union all select '10d', date, ticker, pnl_10 from trade)""", PNL
    )
    result["gap_retrace_points"] = report_query(
        "select ticker, date, gap_up_percent, retrace_percentage_10d, retraced_to_vwap_10d from pub_up"
    )
    per_date = """per_date as (select date, cast(sum(cast(spy_daily_gain_percent as decimal(26,8))) as double)
        /count(spy_daily_gain_percent) spy, avg(cast(retraced_to_vwap_10d as int))*100 rate10 from pub_up group by date)"""
    result["benchmark_vs_retrace"] = report_query("select * from per_date", per_date)
    result["benchmark_trend"] = report_query(
        """select round(regr_slope(rate10, spy), 6) slope, round(regr_intercept(rate10, spy), 6) as intercept,
        round(regr_r2(rate10, spy), 6) r2 from per_date""",
        per_date,
    )
    result["top_mfe"] = report_query(
        """select ticker, date, gap_up_percent, mfe_percent_10d, mae_percent_10d, retrace_percentage_10d from pub_up
        order by mfe_percent_10d desc nulls last, ticker, date limit 20"""
    )

    result["changes_only"] = f"with {EVENTS} select * from chg"
    result["distinct_blocks"] = f"""with {EVENTS}, blk as (select user_id, day,
        string_agg(event_type || ': ' || level, '; ' order by ts, event_id) declarations from chg group by user_id, day),
        firsts as (select user_id, min(day) as day from blk group by user_id, declarations)
        select user_id, day, row_number() over (partition by user_id, day order by ts, event_id) as ordinal, event_type, level
        from chg join firsts using (user_id, day)"""
    result["grouped_first_seen"] = f"""with {EVENTS} select ev.*, first_value(ts) over w first_ts,
        first_value(event_id) over w first_event_id from ev window w as (partition by user_id order by ts, event_id)"""
    style = r"""bodies as (select page_id,
        array_to_string(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1), chr(10)) html from pages)"""
    result["style_rules"] = f"with {style}, {rules('bodies', 'page_id', 'html')} select * from rule"
    # the tokens of each sheet one by one, with the stack of open rules
    result["nested_rules"] = r"""with recursive sheets as (
        select user_id, string_agg(case when event_id % 6 < 2 then '@' || event_type || ' { '
            when event_id % 6 < 4 then event_type || ': ' || event_id || ';' || chr(10)
            else 'last: ' || (event_id % 10) || ' }' || chr(10) end, '' order by ts, event_id) sheet
        from events group by user_id),
    token as (select user_id, unnest(tokens) token, unnest(range(len(tokens))) pos
        from (select user_id, regexp_extract_all(sheet, '[^{};]*[{};]') tokens from sheets)),
    cut as (select user_id, pos, right(token, 1) mark, trim(left(token, -1), chr(10) || ' ') said from token),
    walk(user_id, pos, mark, said, before, stack) as (
        select user_id, pos, mark, said, []::varchar[], case when mark = '{' then [said] else []::varchar[] end from cut where pos = 0
        union all
        select c.user_id, c.pos, c.mark, c.said, w.stack, case when c.mark = '{' then list_append(w.stack, c.said)
            when c.mark = '}' then w.stack[1:len(w.stack) - 1] else w.stack end
        from walk w join cut c on c.user_id = w.user_id and c.pos = w.pos + 1)
    select user_id, cast(pos as int) pos, cast(len(before) as int) as depth, array_to_string(before[1:len(before) - 1], ' / ') as path,
        before[len(before)] as selector, trim(split_part(said, ':', 1)) as attribute, trim(substr(said, instr(said, ':') + 1)) as value
    from walk where mark <> '{' and len(before) > 0 and contains(said, ':')"""
    result["strip_comments"] = r"""select page_id,
        regexp_replace(replace(replace(html, '<!--', '/*'), '-->', '*/'), '/\*.*?\*/', '', 'gs') html from pages"""
    result["strip_comments_in_pieces"] = result["strip_comments"] + " where length(html) > 0"
    sheets = """sheets as (select l_orderkey, string_agg(l_returnflag || ' { status: ' || l_linestatus || ';' || chr(10)
        || '  discount: ' || cast(round(l_discount*20) as int) || '; }' || chr(10), '' order by l_linenumber,
        l_returnflag || ' { status: ' || l_linestatus || ';' || chr(10) || '  discount: '
        || cast(round(l_discount*20) as int) || '; }') sheet from lineitem group by l_orderkey)"""
    result["cleaned_rules"] = f"""with {sheets}, {rules('sheets', 'l_orderkey', 'sheet')},
        kept as (select * from rule window w as (partition by l_orderkey, selector, attribute order by pos, declaration_pos)
                 qualify row_number() over w = 1 or value is distinct from lag(value) over w),
        blk as (select l_orderkey, selector, pos,
                string_agg(attribute || ': ' || value, '; ' order by declaration_pos) declarations
                from kept group by l_orderkey, selector, pos),
        uniq as (select l_orderkey, selector, min(pos) pos, declarations from blk group by l_orderkey, selector, declarations)
        select l_orderkey, selector, first_pos, pos, attribute, value,
               row_number() over (partition by l_orderkey, selector, pos order by declaration_pos) as ordinal
        from kept join (select l_orderkey, selector, pos from uniq) u using (l_orderkey, selector, pos)
        join (select l_orderkey, selector, cast(min(pos) as int) first_pos from cut group by l_orderkey, selector) f
        using (l_orderkey, selector)"""
    for name, sql in {
        "forward_extremes": f"select symbol, date, lowest_5d, highest_5d, lowest_10d, highest_10d from ext_down",
        "mfe_mae": f"select symbol, date, {excursions(5)}, {excursions(10)} from ext_down",
        "retrace_percent": f"select symbol, date, {retrace('down', 5)}, {retrace('down', 10)} from ext_down",
        "gap_closure": f"select symbol, date, {closure('down', 5)}, {closure('down', 10)} from ext_down",
    }.items():
        result[f"{name}_down"] = gap_query(sql, extremes("down"))
    for name, near in {"first_touch_250": "n.rn between g.rn+1 and g.rn+250",
                       "first_touch_calendar_365": "n.date > g.date and n.date <= g.date + 365"}.items():
        result[name] = gap_query(" union all ".join(
            f"""select '{mode}' as mode, g.symbol, g.date, cast(min(n.rn - g.rn) filter ({hit}) as int) touch from room_{mode} g
            left join prev n on n.symbol = g.symbol and {near} group by g.symbol, g.date"""
            for mode, hit in (("up", "n.low <= g.anchored_vwap"), ("down", "n.high >= g.anchored_vwap"))
        ))
    result["retrace_ema21_down"] = gap_query(
        "select symbol, date, ema_21, " + ", ".join(
            f"days_to_21ema_{h}d is not null retraced_to_21ema_{h}d, days_to_21ema_{h}d" for h in HORIZONS
        ) + " from touch_down", EMA, ema_touch("down"),
    )
    result["gap_outcomes_month"] = (
        f"with {full('up')} select * from outcome_up where date between date '1995-03-01' and date '1995-03-31'"
    )
    # one bar after the other
    result["ema_full"] = f"""with recursive {BARS}, numbered as materialized (
        select symbol, date, close, row_number() over (partition by symbol order by date) i from bar),
        walk(symbol, date, i, ema) as (
            select symbol, date, i, close from numbered where i = 1
            union all
            select n.symbol, n.date, n.i, w.ema*(20.0::double/22.0::double) + n.close*(2.0::double/22.0::double)
            from walk w join numbered n on n.symbol = w.symbol and n.i = w.i + 1)
        select symbol, date, case when i >= 21 then round(ema, 6) end ema from walk"""
    result["asof_close"] = f"""with {BARS}, moved as (
        select event_id, case when event_id % 3 = 0 then 'SPY' else 'S' || (1 + user_id % 120) end symbol,
               cast(date '1992-01-01' + cast(event_id * 37 % 2600 as int) as timestamp) + (ts - date_trunc('day', ts)) as at from events)
        select moved.event_id, moved.symbol, moved.at, bar.date close_date, bar.close last_close
        from moved asof left join bar on moved.symbol = bar.symbol and moved.at >= cast(bar.date as timestamp)"""
    tp = "cast(round((b.high+b.low+b.close)*1000000) as hugeint)"
    result["avwap_since"] = f"""with {BARS}, asked as (
        select symbol, date, close, date - cast((day(date) * 131 + month(date) * 17) % 401 as int) as anchor from bar),
        since as (select a.symbol, a.date, any_value(a.close) as close, any_value(a.anchor) as anchor,
            case when sum(b.volume) > 0 then cast(sum({tp}*b.volume) as double)/(cast(sum(b.volume) as double)*3000000.0::double)
            else cast(sum({tp}) as double)/(count({tp})*3000000.0::double) end anchored_vwap
            from asked a join bar b on b.symbol = a.symbol and b.date between a.anchor and a.date group by a.symbol, a.date)
        select *, case when anchored_vwap > 0 then (close-anchored_vwap)/anchored_vwap*100.0::double end avwap_distance_percent from since"""
    result["outcomes_upkept"] = f"with {full('up')} select * from outcome_up"
    result["top_gap_outcomes"] = report_query("select date, rank, ticker, gap_up_percent, {} from ({})".format(
        ", ".join(f"{name}_{h}d" for h in HORIZONS for name in ("retrace_percentage", "mfe_percent", "mae_percent")),
        "select *, cast(row_number() over (partition by date order by gap_up_percent desc, ticker) as int) as rank"
        " from pub_up qualify rank <= 5",
    ))
    for name in ("vwap_by_symbol", "avwap_3d", "avwap_quarterly"):
        scaled = result[name].replace("close, volume from candle", "close, volume*10000000 as volume from candle")
        assert scaled != result[name]
        result[f"{name}_busy"] = scaled

    # the same reports on down gaps
    result["report_header_long"] = report_query(
        "select count(*) row_count, count(distinct date) date_count, max(direction) direction from pub_up", mode="down"
    )
    result["perf_by_year_10d_long"] = report_query(
        f"select cast(year(date) as int) as year, {performance(10)} from pub_up where date is not null group by 1", mode="down"
    )
    result["perf_by_gap_size_10d_long"] = bucket_table(
        buckets.GAP_SIZE, "gap_up_percent", performance(10), f"coalesce(y.trades, 0) trades, {measured}", mode="down"
    )
    for h in HORIZONS:
        result[f"win_by_avwap_distance_{h}d_long"] = win_table(
            buckets.AVWAP_DISTANCE, "greatest(0.0::double, (anchored_vwap-open_price)*100/open_price)", h, mode="down"
        )
    result["equity_curve_long"] = report_query(
        """select horizon, date, ticker, cast(sum(coalesce(cast(pnl as decimal(18,6)), 0)) over (partition by horizon
             order by date nulls last, ticker rows between unbounded preceding and current row) as double) equity
        from (select '5d' horizon, date, ticker, pnl_5 pnl from trade
              union all select '10d', date, ticker, pnl_10 from trade)""", PNL, mode="down"
    )

    # a file with one horizon: what it lacks is unknown
    none = "cast(null as double)"
    result["overall_rates_of_old_file"] = report_query(
        f"""select {none} avwap_rate_5d, {two_decimals(rate('retraced_to_vwap_10d'))} avwap_rate_10d, {none} ema21_rate_5d,
        {none} ema21_rate_10d, {none} gap_fill_rate_5d, {none} gap_fill_rate_10d from pub_up"""
    )
    result["profit_factor_overall_of_old_file"] = report_query(
        f"select {none} profit_factor_5d, coalesce({fraction_pf(10)}, 0) profit_factor_10d from pub_up"
    )
    for h in HORIZONS:
        had = h == 10
        result[f"perf_by_year_{h}d_of_old_file"] = report_query(
            f"""select cast(year(date) as int) as year, count(*) trades,
            {two_decimals(rate('retraced_to_vwap_10d')) if had else none} avwap_rate, {fraction_pf(10) if had else none} avwap_pf,
            {none} gap_close_rate, {none} gap_close_pf, {none} ema21_rate, {none} ema21_pf
            from pub_up where date is not null group by 1"""
        )
        result[f"monthly_win_{h}d_of_old_file"] = result[f"monthly_win_{h}d"] + ("" if had else " where false")
        result[f"win_by_gap_{h}d_of_old_file"] = (
            result[f"win_by_gap_{h}d"] if had else bucket_table(buckets.GAP_WIDE, "gap_up_percent", f"{none} rate", f"{none} rate")
        )
    result["monthly_sma5_of_old_file"] = report_query(
        f"""select month, total, cast(null as bigint) retraced5, retraced10, {none} rate5, r10 rate10, {none} sma5,
           avg(r10) over (order by month rows between 4 preceding and current row) sma10
           from (select *, retraced10*100/total::double r10 from months)""", MONTHS
    )
    result["monthly_win_both_of_old_file"] = report_query("select month, '10d' horizon, win10 rate from months", MONTHS)
    # moving averages and anchors came later, so there is no level to be above or below of
    result["win_above_below_of_old_file"] = f"select * from ({result['win_above_below']}) where false"
    for name in ("report_header", "perf_by_year_10d", "perf_by_gap_size_5d", "monthly_sma5", "gap_histogram", "win_by_avwap_distance_10d",
                 "win_above_below", "days_to_retrace_10d", "benchmark_vs_retrace"):
        result[f"{name}_of_cube"] = result[name]
    result["latest_snapshots"] = f"""with {EVENTS} select * from ev
        where day in (select distinct day from ev where day is not null order by day desc limit 10)"""
    return result
