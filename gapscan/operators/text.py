"""Style text: rules with their declarations, comment removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscan.operators.keyed import changes_only, distinct_blocks

# The pattern of a comment, and that of a flat rule: text up to a brace, then text up to its end.
# What is no rule is matched as well, a stretch at a time, so that no text is looked at twice.
RULE_PATTERN = r"([^{]++)\{([^}]++)\}|[^{]++\{?+|\{"
COMMENT_PATTERN = r"(?s)/\*.*?\*/"
STYLE_PATTERN = r"(?is)<style[^>]*>(.*?)</style>"

_SPACE = " \t\n\r\f\x0b"


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def strip_comments(df: DataFrame, column: str) -> DataFrame:
    """The text without /* ... */ comments, also those over several lines."""
    return df.withColumn(column, F.regexp_replace(column, COMMENT_PATTERN, ""))


def style_bodies(df: DataFrame, html: str) -> DataFrame:
    """Replaces a page by the text of its style elements, joined in order."""
    bodies = F.regexp_extract_all(F.col(html), F.lit(STYLE_PATTERN), F.lit(1))
    return df.withColumn(html, F.array_join(bodies, "\n"))


def _rules(df: DataFrame, text: str) -> DataFrame:
    """Rules by position with selector and body; linear in the text, whatever braces it has."""
    # Behind the last closing brace no rule can end.
    closed = F.expr(f"substring(`{text}`, 1, length(`{text}`) - length(substring_index(`{text}`, '}}', -1)))")
    groups = [F.regexp_extract_all(closed, F.lit(RULE_PATTERN), F.lit(k)) for k in (1, 2)]
    matches = F.zip_with(*groups, lambda selector, body: F.struct(selector.alias("selector"), body.alias("body")))
    found = df.withColumn("_rules", F.filter(matches, lambda rule: rule["selector"] != "")).drop(text)
    rules = found.select("*", F.posexplode("_rules").alias("pos", "_rule")).drop("_rules")
    return rules.withColumns({"selector": _stripped(F.col("_rule.selector")), "_body": F.col("_rule.body")}).drop("_rule")


def _declarations(rules: DataFrame) -> DataFrame:
    parts = rules.withColumn("_parts", F.split(_stripped(F.col("_body")), r";\s*"))
    declarations = parts.select("*", F.posexplode("_parts").alias("declaration_pos", "_text")).where(
        F.contains("_text", F.lit(":"))
    )
    halves = declarations.withColumn("_halves", F.split(F.col("_text"), ":", 2))
    return halves.withColumns({
        "attribute": _stripped(F.get("_halves", F.lit(0))),
        "value": _stripped(F.get("_halves", F.lit(1))),
    }).drop("_body", "_parts", "_text", "_halves")


def extract_rules(df: DataFrame, text: str) -> DataFrame:
    """One row per declaration: rule position, selector, declaration position, attribute, value.

    Declarations end at semicolons and split at the first colon; text without a colon
    is skipped. The pattern knows flat rules only.
    """
    return _declarations(_rules(df, text))


def clean_rules(df: DataFrame, id: str, text: str) -> DataFrame:
    """Each text's rules grouped by selector in order of first sight, repeats removed.

    A declaration stays when it changes what the selector had for the attribute, a
    rule when its remaining declarations are new for the selector. One row per declaration
    that stays, with the position of its rule and of the selector's first rule. A text lies in one row, which
    bounds what its windows hold: they share one partitioning, by text if the table has that already.
    """
    first = F.min("pos").over(Window.partitionBy(id, "selector"))
    declarations = _declarations(_rules(df.select(id, text), text).withColumn("first_pos", first))
    key = [id, "selector", "first_pos"]
    order = ["pos", "declaration_pos"]
    changed = changes_only(declarations, [*key, "attribute"], order, "value", None)
    blocks = distinct_blocks(changed, key, "pos", order, "attribute", "value", None)
    # a sort looks at its rows twice, once for its borders: what it sorts is shuffled before, so that nothing is worked out twice
    return blocks.repartition(id).orderBy(id, "first_pos", "pos", "ordinal")


# What ends a stretch of style text.
TOKEN_PATTERN = r"[^{};]*+[{};]?"


def style_tokens(df: DataFrame, id: str, text: str) -> DataFrame:
    """The stretches of each text up to a brace or semicolon: id, pos, said, mark, level, depth.

    `depth` is how many rules are open behind the mark: the running sum of openings less closings, less its
    lowest value so far, so that a closing brace too many counts for nothing. `level` is the depth before the mark. Text behind
    the last mark belongs to no rule and is left out.
    """
    found = F.filter(F.regexp_extract_all(F.col(text), F.lit(TOKEN_PATTERN), F.lit(0)), lambda t: t.rlike("[{};]$"))
    tokens = df.select(id, F.posexplode(found).alias("pos", "_token"))
    tokens = tokens.withColumns({
        "said": _stripped(F.expr("substring(_token, 1, length(_token) - 1)")),
        "mark": F.expr("right(_token, 1)"),
    }).drop("_token")
    # all windows below are by text, so that one exchange serves them all
    tokens = tokens.repartition(id)
    order = Window.partitionBy(id).orderBy("pos")
    step = F.when(F.col("mark") == "{", 1).when(F.col("mark") == "}", -1).otherwise(0)
    summed = tokens.withColumn("_sum", F.sum(step).over(order))
    deep = summed.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(order))).drop("_sum")
    return deep.withColumn("level", F.coalesce(F.lag("depth").over(order), F.lit(0)))


def nested_rules(df: DataFrame, id: str, text: str) -> DataFrame:
    """One row per declaration inside rules that may hold rules: id, pos, depth, path, selector, attribute, value.

    A declaration ends at a semicolon or at its rule's closing brace and splits at the first colon; text without
    one is skipped. `path` lists the selectors of the rules around its own, outermost first; `depth` is their number plus
    one. The rule open at a depth is the last one opened at it. A closing brace without a rule is skipped, a rule that is never closed
    reaches to the end of the text. Null texts have no rows; equal ids count as one text each only if their texts are in one row.
    """
    tokens = style_tokens(df.where(F.col(text).isNotNull()), id, text)
    opened = tokens.where("mark = '{'").select(id, "pos", F.col("depth").alias("own"), F.col("said").alias("selector"))
    # each rule once for every depth up to its own; the last rule opened at a depth is the one around it
    levels = opened.withColumn("at", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("own").cast("bigint"))))
    last = Window.partitionBy(id, "at").orderBy("pos")
    around = levels.withColumn("name", F.last(F.when(F.col("at") == F.col("own"), F.col("selector")), ignorenulls=True).over(last))
    paths = around.groupBy(id, "pos", "own").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("_path"))
    rules = paths.select(id, "pos", F.col("own").alias("depth"), F.transform("_path", lambda x: x["name"]).alias("_path"), F.lit(None).cast("string").alias("said"))
    said = tokens.where("mark <> '{' and level > 0 and contains(said, ':')")
    said = said.select(id, "pos", F.col("level").alias("depth"), F.lit(None).cast("array<string>").alias("_path"), "said")
    # a declaration belongs to the last rule opened at its depth
    owner = F.last("_path", ignorenulls=True).over(Window.partitionBy(id, "depth").orderBy("pos"))
    owned = rules.unionByName(said).repartition(id).withColumn("_path", owner).where("said is not null")
    halves = owned.withColumn("_halves", F.split(F.col("said"), ":", 2))
    return halves.select(
        id, "pos", F.col("depth").cast("int").alias("depth"), F.slice("_path", F.lit(1), F.col("depth").cast("int") - 1).alias("path"),
        F.element_at("_path", -1).alias("selector"), _stripped(F.get("_halves", F.lit(0))).alias("attribute"), _stripped(F.get("_halves", F.lit(1))).alias("value"),
    )


def _whole_marks(pieces: DataFrame, id: str, piece: str, text: str) -> DataFrame:
    """Pieces cut anew so that no comment mark lies across a cut: what slashes and stars a piece ends with go to the next one.

    Only these ends, not the texts, meet by text; a piece of nothing else passes them on and stays empty.
    """
    cut = pieces.select(id, piece, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    cut = cut.withColumn("_body", F.expr("rtrim('/*', _text)")).withColumn("_run", F.expr("substring(_text, length(_body) + 1)"))
    order = Window.partitionBy(id).orderBy(piece)
    ends = cut.select(id, piece, "_run", (F.col("_body") != "").alias("_solid"))
    ends = ends.withColumn("_solid", F.col("_solid") | (F.row_number().over(order) == 1))
    ends = ends.withColumn("_group", F.sum(F.col("_solid").cast("int")).over(order))
    # a group is a piece with text of its own and those of mere marks behind it: its end goes to the next group, or stays if there is none
    groups = ends.groupBy(id, "_group").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct(piece, "_run")))["_run"], "").alias("_carry"), F.min(piece).alias("_head")
    )
    by_group = Window.partitionBy(id).orderBy("_group")
    heads = groups.select(
        F.col(id).alias("_id"), "_head", F.coalesce(F.lag("_carry").over(by_group), F.lit("")).alias("_before"),
        F.when(F.lead("_group").over(by_group).isNull(), F.col("_carry")).otherwise("").alias("_behind"),
    )
    placed = cut.join(heads, F.col(id).eqNullSafe(F.col("_id")) & (F.col(piece) == F.col("_head")), "left")
    return placed.select(id, piece, F.when(F.col("_head").isNotNull(), F.concat("_before", "_body", "_behind")).otherwise("").alias(text))


def strip_comments_in_pieces(df: DataFrame, id: str, piece: str, text: str) -> DataFrame:
    """(id, piece, text): texts that lie in pieces, in the order of `piece`, without /* ... */ comments.

    Put together, the pieces are what `strip_comments` leaves of the whole text, however it was cut; a comment that is never closed stays.
    A piece is a map of two states, outside or inside a comment, to the state behind it, found in each piece by itself. The state that
    a piece begins in follows from the last piece before it that leads to one state from both, and from how many swap the two since; only
    these small rows meet by text, so a text of any length is many tasks' work. Pieces have different numbers within a text; a null piece of text is
    empty, null ids are one text.
    """
    whole = _whole_marks(df, id, piece, text).withColumn("_stretches", F.split(text, COMMENT_PATTERN, -1))
    # begun outside: whole comments go, and the last stretch may open one; begun inside: the same behind the first close
    last = lambda name: F.element_at(name, -1)
    opens = lambda name: F.instr(last(name), "/*")
    closed = F.instr(text, "*/")
    whole = whole.withColumn("_later", F.when(closed > 0, F.split(F.expr(f"substring(`{text}`, instr(`{text}`, '*/') + 2)"), COMMENT_PATTERN, -1)))
    whole = whole.withColumns({"_from_out": (opens("_stretches") > 0).cast("int"), "_from_in": F.when(F.col("_later").isNull(), 1).otherwise((opens("_later") > 0).cast("int"))})
    maps = whole.select(F.col(id).alias("_id"), F.col(piece).alias("_piece"), "_from_out", "_from_in", F.col("_later").isNull().alias("_through"))
    by_piece = Window.partitionBy("_id").orderBy("_piece")
    earlier = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum(F.when((F.col("_from_out") == 1) & (F.col("_from_in") == 0), 1).otherwise(0))
    maps = maps.withColumn("_swapped", F.coalesce(swaps.over(earlier), F.lit(0)))
    fixed = F.when(F.col("_from_out") == F.col("_from_in"), F.struct(F.col("_from_out").alias("state"), F.col("_swapped").alias("swapped")))
    maps = maps.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(earlier))
    since = F.col("_swapped") - F.coalesce(F.col("_fixed.swapped"), F.lit(0))
    maps = maps.withColumn("_start", ((F.coalesce(F.col("_fixed.state"), F.lit(0)) + since) % 2).cast("int"))
    maps = maps.withColumn("_end", F.when(F.col("_start") == 0, F.col("_from_out")).otherwise(F.col("_from_in")))
    # the comment that is open at the end was opened in the last piece that does not pass through inside
    after = by_piece.rowsBetween(1, Window.unboundedFollowing)
    passes = (F.col("_start") == 1) & F.col("_through")
    maps = maps.withColumn("_open", (F.col("_end") == 1) & F.coalesce(F.min(passes).over(after), F.lit(True)))
    found = whole.drop("_from_out", "_from_in").join(maps.select("_id", "_piece", "_start", "_end", "_open"), F.col(id).eqNullSafe(F.col("_id")) & (F.col(piece) == F.col("_piece")))

    def kept(name: str) -> Column:
        """All but the last stretch, and of that what is before a comment it opens, unless that one is never closed."""
        front = F.array_join(F.slice(name, 1, F.greatest(F.size(name) - 1, F.lit(0))), "")
        end = F.when((opens(name) > 0) & ~F.col("_open"), F.substring(last(name), F.lit(1), opens(name) - 1)).otherwise(last(name))
        return F.concat(front, end)

    inside = F.when(F.col("_later").isNotNull(), kept("_later")).when(F.col("_open"), F.col(text)).otherwise("")
    return found.select(id, piece, F.when(F.col("_start") == 0, kept("_stretches")).otherwise(inside).alias(text))
