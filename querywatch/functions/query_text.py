"""Canonical text, digest and type of SQL statements, within Catalyst.

A statement is cut into tokens by one alternation; tokens are mapped one by one, joined by blanks, and runs of
literals collapse. Known gap: nested block comments inside hints are not told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MOST = 8192  # fixed value: characters of canonical text
# hints, comments, quoted literals (an open quote stays alone), quoted names, numbers, words, operators
TOKEN = (
    r"(?s)/\*\+.*?\*/|/\*.*?\*/|--[ \t][^\n]*|#[^\n]*|'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"|`[^`]*`"
    r"|0[xX][0-9a-fA-F]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[\p{L}_$@][\p{L}0-9_$@]*|<=>|<>|!=|<=|>=|\|\||&&|:=|->>?|[^\s]"
)
#: Reserved words, which canonical text has in capitals. Words that differ in one part only are made from it below.
_WORDS = (
    "ADD ALL ALTER ANALYZE AND ARRAY AS ASC BEFORE BETWEEN BINARY BLOB BOTH BY CALL CASCADE CASE CHANGE CHAR CHARACTER CHECK COLLATE COLUMN CONDITION CONSTRAINT CONTINUE CONVERT CREATE CROSS "
    "CUBE CUME_DIST CURRENT_USER CURSOR DEC DECIMAL DECLARE DEFAULT DELAYED DELETE DESC DESCRIBE DETERMINISTIC DISTINCT DISTINCTROW DIV DOUBLE DROP DUAL EACH ELSE ELSEIF EMPTY ENCLOSED "
    "ESCAPED EXCEPT EXISTS EXIT EXPLAIN FALSE FETCH FLOAT FOR FORCE FOREIGN FROM FULLTEXT FUNCTION GENERATED GET GRANT GROUPING HAVING HIGH_PRIORITY IF IGNORE INDEX INFILE INNER INSERT INTEGER "
    "INTERSECT INTERVAL INTO IS ITERATE JOIN JSON_TABLE KILL LAG LATERAL LEAD LEADING LEAVE LEFT LIKE LIMIT LINEAR LINES LOAD LOCALTIME LOCALTIMESTAMP LONG LOOP LOW_PRIORITY MATCH MAXVALUE "
    "MEMBER MOD MODIFIES NATURAL NOT NO_WRITE_TO_BINLOG NTILE NULL NUMERIC OF ON OPTIMIZE OPTIMIZER_COSTS OPTION OPTIONALLY OR ORDER OUTER OUTFILE OVER PARTITION PRECISION PRIMARY PROCEDURE "
    "PURGE RANGE READ_WRITE REAL RECURSIVE REFERENCES REGEXP RELEASE RENAME REPEAT REPLACE REQUIRE RESTRICT RETURN REVOKE RIGHT RLIKE ROW_NUMBER SELECT SEPARATOR SET SHOW SPATIAL SPECIFIC SQL "
    "SSL STARTING STORED STRAIGHT_JOIN SYSTEM TABLE TERMINATED THEN TO TRAILING TRIGGER TRUE UNDO UNION UNIQUE UNSIGNED UPDATE USAGE USE USING VALUES VARYING VIRTUAL WHEN WHERE WHILE WINDOW "
    "WITH WRITE XOR YEAR_MONTH ZEROFILL"
).split()
_UNITS = ("DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND")
_FAMILIES = (
    (("DATABASE", "GROUP", "KEY", "READ", "ROW", "SCHEMA"), ("", "S")), (("", "DENSE_", "PERCENT_"), ("RANK",)), (("FIRST_", "LAST_", "NTH_"), ("VALUE",)), (("CURRENT_", "UTC_"), ("DATE", "TIME", "TIMESTAMP")),
    (("LONG", "MEDIUM", "TINY"), ("BLOB", "TEXT")), (("", "BIG", "MEDIUM", "MIDDLE", "SMALL", "TINY"), ("INT",)), (("INT",), ("1", "2", "3", "4", "8")), (("FLOAT",), ("4", "8")), (("VAR",), ("BINARY", "CHAR", "CHARACTER")),
    (("", "A", "IN"), ("SENSITIVE",)), (("", "UN"), ("LOCK",)), (("", "RE"), ("SIGNAL",)), (("IN", "INOUT", "OUT"), ("",)), (("SQL",), ("EXCEPTION", "STATE", "WARNING", "_BIG_RESULT", "_CALC_FOUND_ROWS", "_SMALL_RESULT")),
    (("MASTER_", "SOURCE_"), ("BIND", "SSL_VERIFY_SERVER_CERT")), (("IO_AFTER_", "IO_BEFORE_"), ("GTIDS",)),
)
KEYWORDS = sorted({*_WORDS, *(a + b for heads, tails in _FAMILIES for a in heads for b in tails), *(f"{a}_{b}" for i, a in enumerate(_UNITS) for b in _UNITS[i + 1 :])})
#: Words that mean the same.
SYNONYMS = {
    "distinctrow": "distinct", "character": "char", "int": "integer", "regexp": "rlike", "substr": "substring", "mid": "substring", "database": "schema",
    "current_timestamp": "now", "localtime": "now", "localtimestamp": "now", "current_date": "curdate", "current_time": "curtime",
}


DDL, DML = ("create", "alter", "drop", "rename", "truncate"), ("select", "insert", "update", "delete", "replace")


def tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: ~(t.rlike(r"^/\*[^+]") | t.rlike(r"^(--|#)") | (t == ";")))


def canonical(text: Column, keywords: list[str] = KEYWORDS) -> Column:
    """One spelling for all statements that differ in literals, case, comments, spacing and synonyms alone."""
    same, units = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair]), "sql_tsi_"
    capital = [w.lower() for w in keywords]

    def word(low: Column) -> Column:
        """Most words need one look into a set; only those that have a synonym are looked up in the map, which is searched in order."""
        other = F.element_at(same, low)
        folded = F.when(low.isin(*[k for k in SYNONYMS if SYNONYMS[k] in capital]), F.upper(other)).when(low.isin(*SYNONYMS), other)
        return folded.when(low.isin(*capital), F.upper(low)).when(low.startswith(units), F.substring(low, len(units) + 1, 64)).otherwise(low)

    def render(t: Column) -> Column:
        return (
            F.when(t.startswith("/*+"), F.concat(F.lit("/*+ "), F.trim(F.substring(t, F.lit(4), F.char_length(t) - 5)), F.lit(" */")))
            .when(t.rlike(r"""^(['"].+['"]$|''|""|[0-9]|\.[0-9])"""), "?").when(t == "<>", "!=").when(t == "&&", "AND")
            .when(t.startswith("`") & (t != "`"), F.lower(F.regexp_replace(t, "`", ""))).otherwise(word(F.lower(t)))
        )

    joined = F.array_join(F.transform(tokens(text), render), " ")
    rows = F.regexp_replace(joined, r"\( \?(?: , \?)* \)(?: , \( \?(?: , \?)* \))*", "( ... )")
    return F.substring(F.regexp_replace(rows, r"\?(?: , \?)+", "? , ..."), 1, MOST)


def app_digest(canonical_text: Column) -> Column:
    return F.substring(F.sha2(canonical_text, 256), 1, 32)


def statement_type(canonical_text: Column) -> Column:
    """By the first word behind hints and brackets; after WITH by the first such word outside brackets, however deep they go."""
    bare = F.trim(F.regexp_replace(F.coalesce(canonical_text, F.lit("")), r"(?s)/\*\+.*?\*/", ""))
    words = F.split(F.regexp_replace(bare, r"^[( ]+", ""), " +")
    state = lambda depth, kind: F.struct(depth.alias("depth"), kind.alias("kind"))
    known = [w.upper() for w in DML] + [w.upper() for w in DDL if w != "truncate"] + ["truncate"]
    fold = F.aggregate(
        words, state(F.lit(0), F.lit(None).cast("string")),
        lambda acc, w: state(acc["depth"] + F.when(w == "(", 1).when(w == ")", -1).otherwise(0), F.when(acc["kind"].isNull() & (acc["depth"] == 0) & w.isin(*known), w).otherwise(acc["kind"])),
        lambda acc: acc["kind"])
    first = F.get(words, F.lit(0))
    kind = F.lower(F.when(first == "WITH", fold).when(first.isin(*known), first))
    return F.when(kind.isin(*DDL), "ddl").when(kind.isin(*DML), kind).otherwise("other")


def mask_ok(canonical_text: Column) -> Column:
    """No quote and no literal is left outside hints."""
    rest = F.regexp_replace(canonical_text, r"/\*\+.*?\*/", "")
    return ~rest.rlike(r"""['"`]""") & ~rest.rlike(r"(^| )[.]?[0-9][0-9.]*( |$)")


def server_truncated(text: Column, limit: int = 1024) -> Column:
    ticks = F.char_length(text) - F.char_length(F.replace(text, F.lit("`"), F.lit("")))
    return text.endswith("...") | (ticks % 2 == 1) | text.rlike(r"[=<>+*/,(-]\s*$") | (F.octet_length(text) >= limit)


NAME = r"^[\p{Ll}_$][\p{L}0-9_$]*$"
OPENERS, HINTS = ("FROM", "JOIN", "STRAIGHT_JOIN", "UPDATE"), ("USE", "FORCE", "IGNORE", "PARTITION")
#: What a fold over the tokens waits for: nothing; a source; a dot, alias or hint behind its name; the name behind a dot; an alias;
#: the brackets of a hint; the end of brackets that are skipped, of a hint or a derived table; AS or the name of the latter; its name; a comma.
IDLE, SOURCE, NAMED, DOTTED, FULL, ALIAS, HINT, IN_HINT, IN_TABLE, DERIVED, CALLED, COMMA = range(12)


def table_refs(canonical_text: Column) -> Column:
    """(schema_name, table_name, alias) in order, behind FROM, JOIN and UPDATE and in their comma lists; derived tables are skipped whole.

    One fold over the tokens keeps what is awaited and the depth of brackets that are skipped, so nesting has no limit.
    """
    text = F.lit(None).cast("string")
    none = F.struct(text.alias("schema_name"), text.alias("table_name"), text.alias("alias"))
    words = F.split(F.trim(F.regexp_replace(F.coalesce(canonical_text, F.lit("")), r"(?s)/\*\+.*?\*/", "")), " +")
    state = lambda at, depth, one, done: F.struct(F.lit(at).cast("int").alias("at") if isinstance(at, int) else at.cast("int").alias("at"), depth.alias("depth"), one.alias("one"), done.alias("done"))

    def step(acc: Column, w: Column) -> Column:
        at, depth, one = acc["at"], acc["depth"], acc["one"]
        name, capital = w.rlike(NAME), w.rlike("^[A-Z][A-Z0-9_]*$")
        opens, hint, comma = w.isin(*OPENERS), w.isin(*HINTS), w == ","
        behind = F.when(opens, SOURCE).when(comma, SOURCE).otherwise(IDLE)  # a source has ended before this token
        afresh = F.when(opens, SOURCE).otherwise(IDLE)
        then = (
            F.when(at == IDLE, afresh)
            .when(at == SOURCE, F.when(w == "(", IN_TABLE).when(name, NAMED).otherwise(afresh))
            .when((at == NAMED) & (w == "."), DOTTED)
            .when(at == DOTTED, F.when(name, FULL).otherwise(afresh))
            .when((at == HINT) & (w == "("), IN_HINT)
            .when((at == HINT) & capital, HINT)
            .when(at.isin(NAMED, FULL, HINT), F.when(hint, HINT).when(w == "AS", ALIAS).when(name, COMMA).otherwise(behind))
            .when(at == ALIAS, F.when(name, COMMA).otherwise(behind))
            .when(at == IN_HINT, F.when((w == ")") & (depth == 1), FULL).otherwise(IN_HINT))
            .when(at == IN_TABLE, F.when((w == ")") & (depth == 1), DERIVED).otherwise(IN_TABLE))
            .when(at == DERIVED, F.when(w == "AS", CALLED).when(name, COMMA).otherwise(behind))
            .when(at == CALLED, F.when(name, COMMA).otherwise(behind))
            .otherwise(behind)
        )
        deep = F.when(((at == SOURCE) | (at == HINT)) & (w == "("), 1).when(at.isin(IN_HINT, IN_TABLE), depth + F.when(w == "(", 1).when(w == ")", -1).otherwise(0)).otherwise(0)
        held = at.isin(NAMED, FULL, HINT, ALIAS)
        ended = held & then.isin(COMMA, SOURCE, IDLE)
        now = F.when(name, one.withField("alias", w)).otherwise(one)
        kept = (
            F.when((at == SOURCE) & name, none.withField("table_name", w))
            .when((at == DOTTED) & name, F.struct(one["table_name"].alias("schema_name"), w.alias("table_name"), text.alias("alias"))).when(ended | (at == DOTTED), none).otherwise(one)
        )
        return state(then, deep, kept, F.when(ended, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]))

    end = lambda acc: F.when(acc["at"].isin(NAMED, FULL, HINT, ALIAS, IN_HINT), F.concat(acc["done"], F.array(acc["one"]))).otherwise(acc["done"])
    return F.aggregate(words, state(IDLE, F.lit(0), none, F.array().cast("array<struct<schema_name:string,table_name:string,alias:string>>")), step, end)


def table_names(canonical_text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(table_refs(canonical_text), lambda r: F.concat_ws(".", r["schema_name"], r["table_name"]))))


def digest_query_log(log: DataFrame) -> DataFrame:
    """Statement log to one row per digest."""
    rows = log.select(canonical(F.col("sql_text")).alias("canonical"), server_truncated(F.col("sql_text")).alias("cut"))
    out = rows.groupBy("canonical").agg(F.count(F.lit(1)).alias("executions"), F.bool_or("cut").alias("truncated"))
    c = F.col("canonical")
    return out.select(app_digest(c).alias("app_digest"), c, statement_type(c).alias("statement_type"), mask_ok(c).alias("mask_ok"), F.array_join(table_names(c), ",").alias("tables"), "executions", "truncated")
