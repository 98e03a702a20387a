"""Client relations: addresses, access rules, connection strings, grants and accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.fixed import (
    BEGIN_MARK,
    END_MARK,
    IDENT_MAP,
    IDENT_PAIRS,
    MIRRORED_KEYS,
    MONITOR_ACCOUNT,
    OWNER_ACCOUNT,
    PUBLIC_SCHEMA,
    REPLICATION_ACCOUNT,
)
from fleetlens.functions.managed import block, commented_out, is_code, lines_without_block
from fleetlens.functions.ordered import numbered
from fleetlens.functions.skew import spread_join
from fleetlens.functions.text import (
    BLANKS,
    account_name,
    addr_range,
    csv_items,
    quote_ident,
    service_of,
    split_rules,
    unit_number,
)

RELATIONS_TYPE = "map<string,map<string,map<string,map<string,variant>>>>"


def flatten_relations(df: DataFrame, column: str = "relations") -> DataFrame:
    """Nested relation settings (JSON text or map) to one row per remote unit.

    Adds ``relname, relid, unit, settings``; null settings are dropped, as
    assigning null removes a key. Values of other types than text are no settings either;
    ``rejected_settings`` reports them.
    """
    kept = [*(c for c in df.columns if c != column), "relname", "relid", "unit"]
    flat = _remote_units(df, column)
    if dict(df.dtypes)[column] != "string":
        return flat.select(*kept, F.map_filter("_settings", lambda k, v: v.isNotNull()).alias("settings"))
    texts = F.map_filter("_settings", lambda k, v: F.coalesce(_kind(v) == "text", F.lit(False)))
    return flat.select(*kept, F.transform_values(texts, lambda k, v: F.try_variant_get(v, "$", "string")).alias("settings"))


def _remote_units(df: DataFrame, column: str) -> DataFrame:
    nested = F.col(column)
    if dict(df.dtypes)[column] == "string":
        nested = F.from_json(nested, RELATIONS_TYPE)
    kept = [c for c in df.columns if c != column]
    return (
        df.select(*kept, F.explode(nested).alias("relname", "_ids"))
        .select(*kept, "relname", F.explode("_ids").alias("relid", "_units"))
        .select(*kept, "relname", "relid", F.explode("_units").alias("unit", "_settings"))
    )


def _kind(value: Column) -> Column:
    """What a JSON value is: text, number, boolean, object or array; null for a null."""
    told = F.substring_index(F.schema_of_variant(value), "<", 1)
    return (
        F.when(told == "STRING", F.lit("text"))
        .when(told == "BOOLEAN", F.lit("boolean"))
        .when(told == "OBJECT", F.lit("object"))
        .when(told == "ARRAY", F.lit("array"))
        .when(told != "VOID", F.lit("number"))
    )


def rejected_settings(df: DataFrame, column: str = "relations") -> DataFrame:
    """Settings in relation documents (JSON text) that are no texts: a row for each with its ``kind``."""
    kept = [*(c for c in df.columns if c != column), "relname", "relid", "unit"]
    each = _remote_units(df, column).select(*kept, F.explode("_settings").alias("key", "_value"))
    return each.select(*kept, "key", _kind(F.col("_value")).alias("kind")).where(F.col("kind") != "text")


def status_units(df: DataFrame, column: str = "status") -> DataFrame:
    """Status documents (JSON text) to a row per unit.

    Adds ``application, unit, current, message, leader, role``. Applications are under
    ``applications``, or ``services`` in older documents; ``role`` is what a message that
    begins with ``Live`` says next. Values that are no texts, and documents or parts that
    don't parse, give nulls or no rows; a unit without a status has nulls.
    """
    kept = [c for c in df.columns if c != column]

    def part(bag: str, path: str, kind: str) -> Column:
        return F.try_variant_get(F.col(bag), path, kind)

    def told(name: str) -> Column:
        path = f"$['workload-status'].{name}"
        return F.when(_kind(part("_unit", path, "variant")) == "text", part("_unit", path, "string"))

    bags = "map<string,variant>"
    parsed = df.select(*kept, F.try_parse_json(column).alias("_status"))
    apps = F.coalesce(part("_status", "$.services", bags), part("_status", "$.applications", bags))
    units = (
        parsed.select(*kept, F.explode(apps).alias("application", "_app"))
        .select(*kept, "application", F.explode(part("_app", "$.units", bags)).alias("unit", "_unit"))
        .select(*kept, "application", "unit", told("current").alias("current"), told("message").alias("message"),
                F.coalesce(part("_unit", "$.leader", "boolean"), F.lit(False)).alias("leader"))
    )
    role = F.when(F.startswith("message", F.lit("Live ")), F.split_part(F.col("message"), F.lit(" "), F.lit(2)))
    return units.withColumn("role", role)


def address_columns(flat: DataFrame, settings: str = "settings") -> DataFrame:
    """Pull the three address settings out of a settings map; null means not set."""
    bag = F.col(settings)
    return flat.withColumns(
        {
            "egress": F.try_element_at(bag, F.lit("egress-subnets")),
            "ingress": F.try_element_at(bag, F.lit("ingress-address")),
            "private": F.try_element_at(bag, F.lit("private-address")),
        }
    )


def address_list(egress: Column, ingress: Column, private: Column) -> Column:
    """Ranges a unit connects from. The first setting present decides, even if empty."""
    return (
        F.when(egress.isNotNull(), csv_items(egress))
        .when(ingress.isNotNull(), F.array(addr_range(ingress)))
        .when(private.isNotNull(), F.array(addr_range(private)))
        .otherwise(F.array().cast("array<string>"))
    )


def incoming(df: DataFrame) -> DataFrame:
    """One row per incoming address of each unit, with its position."""
    kept = [c for c in df.columns if c not in ("egress", "ingress", "private")]
    found = address_list(F.col("egress"), F.col("ingress"), F.col("private"))
    return df.select(*kept, F.posexplode(found).alias("pos", "address"))


# Sections of the rules, in the order in which they must be matched.
SECTIONS = ("local", "peer", "db", "db-admin", "master", "admin", "extra", "reject")
RULE_ORDER = ("section", "relid", "number", "pos", "item")


def access_rules(clusters: DataFrame, peers: DataFrame, relations: DataFrame) -> DataFrame:
    """Access rules of each cluster. First match wins, so sort by ``RULE_ORDER`` to use them.

    ``clusters(cluster, admin_addresses, extra_rules)``;
    ``peers(cluster, unit, number, egress, ingress, private)``;
    ``relations`` = peers' columns plus ``relname, relid`` and the published
    ``database, user, schema_user``. Each input is read once. The order is carried
    in columns, never by numbering a whole cluster.
    """

    def tokens(*parts: str | Column) -> Column:
        return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])

    def entry(section: str, item: int, rule: Column, pos: Column | None = None) -> Column:
        return F.struct(
            F.lit(SECTIONS.index(section)).alias("section"),
            (F.lit(0) if pos is None else pos).cast("bigint").alias("pos"),
            F.lit(item).alias("item"),
            rule.alias("rule"),
        )

    def numbered(section: str, rules: Column) -> Column:
        return F.transform(rules, lambda rule, pos: entry(section, 0, rule, pos))

    def emit(df: DataFrame, entries: Column, *known: str) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        order = [(F.col(c).cast("bigint") if c in known else zero).alias(c) for c in ("relid", "number")]
        return df.select("cluster", *order, F.explode(entries).alias("_e")).select(
            "cluster", "_e.section", "relid", "number", "_e.pos", "_e.item", "_e.rule"
        )

    def login(database: str | Column, account: str | Column, address: Column) -> Column:
        return tokens("host", database, account, quote_ident(address), "md5")

    own = [
        tokens("local", "all", OWNER_ACCOUNT, "peer", f"map={IDENT_MAP}"),
        tokens("local", "all", MONITOR_ACCOUNT, "password"),
        tokens("local", "all", "all", "peer"),
    ]
    refuse = [tokens("local", "all", "all", "reject"), tokens("host", "all", "all", "all", "reject")]
    admins = F.filter(F.split("admin_addresses", ","), lambda a: a != "")
    by_cluster = F.concat(
        F.array(*[entry("local", i, r) for i, r in enumerate(own)]),
        numbered("admin", F.transform(admins, lambda a: login("all", "all", addr_range(a)))),
        numbered("extra", split_rules(F.col("extra_rules"))),
        F.array(*[entry("reject", i, r) for i, r in enumerate(refuse)]),
    )

    address, pos = F.col("address"), F.col("pos")
    by_peer = F.array(
        *[
            entry("peer", i, login(database, REPLICATION_ACCOUNT, address), pos)
            for i, database in enumerate(("replication", "postgres"))
        ]
    )

    relname = F.col("relname")
    database, user, schema_user = (
        quote_ident(F.col(c)) for c in ("database", "user", "schema_user")
    )

    def for_client(section: str, item: int, rule: Column, *needs: str) -> Column:
        ready = relname == section
        for c in needs:
            ready = ready & F.col(c).isNotNull()
        return F.when(ready, entry(section, item, rule, pos))

    by_relation = F.array_compact(
        F.array(
            for_client("db", 0, login(database, user, address), "database"),
            for_client("db", 1, login(database, schema_user, address), "database", "schema_user"),
            for_client("db-admin", 0, login("all", "all", address)),
            for_client("master", 0, login("replication", user, address)),
            for_client("master", 1, login(database, user, address), "database"),
        )
    )
    return (
        emit(clusters, by_cluster)
        .unionByName(emit(incoming(peers), by_peer, "number"))
        .unionByName(
            emit(
                incoming(relations).where(F.col("user").isNotNull()), by_relation, "relid", "number"
            )
        )
    )


def retire_rules(texts: DataFrame, text: str = "text") -> DataFrame:
    """A rules text without its managed block and with every other rule commented out."""
    return texts.withColumn(
        text, commented_out(lines_without_block(F.col(text)), is_code)
    )


def rules_lines(rules: DataFrame) -> DataFrame:
    """Lines ``(cluster, line_no, line)`` of each cluster's block of rules, its marks included.

    Numbers run on over all partitions, so that a block is written in order however many
    rules it has; ``write_rules`` does so.
    """
    edge = rules.select("cluster").distinct().select(
        "cluster", F.explode(F.array(F.struct(F.lit(-1).alias("section"), F.lit(BEGIN_MARK).alias("rule")),
                                     F.struct(F.lit(len(SECTIONS)).alias("section"), F.lit(END_MARK).alias("rule")))).alias("_e")
    ).select("cluster", "_e.section", "_e.rule")
    every = rules.select("cluster", *RULE_ORDER, "rule").unionByName(edge, allowMissingColumns=True)
    return numbered(every, ["cluster"], [*RULE_ORDER, "rule"], "line_no").select("cluster", "line_no", F.col("rule").alias("line"))


def rules_file(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules text of each cluster: the retired old one and a new block of ``access_rules``.

    ``texts(cluster, text)``; a cluster without rules gets an empty block. All rules of a
    cluster make one text, so a list holds as many as its file has lines.
    """
    in_order = F.struct(*[F.col(c) for c in RULE_ORDER], F.col("rule"))
    ordered = rules.groupBy("cluster").agg(F.sort_array(F.collect_list(in_order)).alias("_rules"))
    lines = F.coalesce(F.transform("_rules", lambda r: r["rule"]), F.array().cast("array<string>"))
    return spread_join(retire_rules(texts), ordered, ["cluster"], "left").select(
        "cluster", F.concat("text", F.lit("\n"), block(lines)).alias("text")
    )


RELATION = ("cluster", "relname", "relid")


def allowed_units(relations: DataFrame, keys: Sequence[str] = RELATION) -> DataFrame:
    """Units of each relation that have an address: a row for each, in order of ``number, unit``."""
    reachable = relations.where(
        F.size(address_list(F.col("egress"), F.col("ingress"), F.col("private"))) > 0
    )
    return reachable.select(*keys, "number", "unit").distinct()


def allowed_subnets(relations: DataFrame, keys: Sequence[str] = RELATION) -> DataFrame:
    """Distinct address ranges of each relation: a row for each, in order of ``address``."""
    return incoming(relations).select(*keys, "address").distinct()


def connection_string(fields: dict[str, Column]) -> Column:
    """``key=value`` pairs in key order; null unless every field is set."""

    def quoted(v: Column) -> Column:
        v = v.cast("string")
        escaped = F.regexp_replace(F.translate(v, "\n", " "), r"(['\\])", r"\\$1")
        return F.when(F.contains(escaped, F.lit(" ")), F.concat(F.lit("'"), escaped, F.lit("'"))).otherwise(escaped)

    ready: Column = F.lit(True)
    for v in fields.values():
        ready = ready & F.coalesce(v.cast("string") != "", F.lit(False))
    pairs = [F.concat(F.lit(f"{k}="), quoted(v)) for k, v in sorted(fields.items())]
    return F.when(ready, F.concat_ws(" ", *pairs))


def unit_strings(units: DataFrame) -> DataFrame:
    """Add ``conn``, the connection string of each publishing unit."""
    fields = {k: F.col(k) for k in ("host", "port", "user", "password")}
    return units.withColumn("conn", connection_string({**fields, "dbname": F.col("database")}))


def connection_strings(units: DataFrame, keys: Sequence[str] = RELATION) -> DataFrame:
    """Connection strings of each relation ``(keys, role, unit, conn)``, a row for each unit.

    ``units`` has one row per relation and publishing unit, with ``is_master``; the role is
    ``master`` or ``standby``. A unit without a usable string has a null ``conn`` if it is a
    master and no row if it is a standby.
    """
    role = F.when(F.col("is_master"), F.lit("master")).otherwise(F.lit("standby"))
    ready = unit_strings(units).select(*keys, role.alias("role"), "unit", "conn")
    return ready.where((F.col("role") == "master") | F.col("conn").isNotNull())


def missing_grants(
    wanted: DataFrame, roles: DataFrame, memberships: DataFrame
) -> DataFrame:
    """Roles ``wanted(cluster, account, roles)`` (comma list) that the account does not hold.

    ``roles(cluster, oid, rolname)`` names both ends of ``memberships(cluster, member,
    roleid)``; numbers and names of roles repeat across clusters. Roles held but not wanted
    are left alone.
    """
    member = roles.select("cluster", F.col("oid").alias("member"), F.col("rolname").alias("account"))
    held_role = roles.select("cluster", F.col("oid").alias("roleid"), F.col("rolname").alias("role"))
    held = (
        memberships.join(member, ["cluster", "member"])
        .join(held_role, ["cluster", "roleid"])
        .select("cluster", "account", "role")
        .distinct()
    )
    return _asked_roles(wanted).join(held, ["cluster", "account", "role"], "left_anti")


def _asked_roles(wanted: DataFrame) -> DataFrame:
    return (
        wanted.select("cluster", "account", F.explode(F.split("roles", ",")).alias("role"))
        .where(F.col("role") != "")
        .distinct()
    )


def missing_roles(wanted: DataFrame, roles: DataFrame) -> DataFrame:
    """Roles that some account of ``wanted(cluster, account, roles)`` asks for and the cluster lacks."""
    asked = _asked_roles(wanted).select("cluster", "role").distinct()
    return asked.join(roles.select("cluster", F.col("rolname").alias("role")).distinct(), ["cluster", "role"], "left_anti")


def wanted_extensions(wanted: DataFrame) -> DataFrame:
    """``name`` or ``name(schema)`` items of ``wanted(datname, extensions)`` as rows.

    A name ends at a blank or a bracket. A schema is a word in brackets after it; what is
    in brackets but no word, and anything after, doesn't count. Items without a name
    are left to ``refused_extensions``.
    """
    named = _extension_items(wanted).where(F.col("_name") != "")
    after = F.ltrim(F.substring(F.col("_bare"), F.length("_name") + 1, F.length("_bare")), F.lit(BLANKS))
    inside = F.substring_index(F.substring(after, F.lit(2), F.length(after)), ")", 1)
    told = F.startswith(after, F.lit("(")) & F.contains(after, F.lit(")")) & inside.rlike(r"(?U)^\w+$")
    return named.select(
        "datname", F.col("_name").alias("extension"), F.when(told, inside).otherwise(F.lit(PUBLIC_SCHEMA)).alias("schema")
    ).distinct()


def _extension_items(wanted: DataFrame) -> DataFrame:
    items = wanted.select("datname", F.explode(F.split("extensions", ",")).alias("item")).where(F.col("item") != "")
    bare = items.withColumn("_bare", F.ltrim("item", F.lit(BLANKS)))
    return bare.withColumn("_name", F.substring_index(F.regexp_replace("_bare", r"[(\s]", "("), "(", 1))


def refused_extensions(wanted: DataFrame) -> DataFrame:
    """Items ``(datname, item)`` of ``wanted(datname, extensions)`` that name no extension."""
    return _extension_items(wanted).where(F.col("_name") == "").select("datname", "item").distinct()


def missing_extensions(
    wanted: DataFrame, extensions: DataFrame, namespaces: DataFrame
) -> DataFrame:
    """Wanted extensions not installed in the wanted schema.

    ``extensions(datname, extname, extnamespace)``; ``namespaces(datname, oid, nspname)``.
    """
    installed = extensions.join(
        namespaces,
        (extensions["datname"] == namespaces["datname"])
        & (extensions["extnamespace"] == namespaces["oid"]),
    ).select(
        extensions["datname"],
        F.col("extname").alias("extension"),
        F.col("nspname").alias("schema"),
    ).distinct()
    return wanted_extensions(wanted).join(
        installed, ["datname", "extension", "schema"], "left_anti"
    )


def missing_schemas(missing: DataFrame) -> DataFrame:
    """Schemas that must exist before the missing extensions can go in."""
    return missing.where(F.col("schema") != PUBLIC_SCHEMA).select("datname", "schema").distinct()


def relation_account(unit: Column, relname: Column) -> Column:
    """The account a relation's clients log in with."""
    return (
        F.when(relname == "db", account_name(unit, "plain"))
        .when(relname == "db-admin", account_name(unit, "admin"))
        .when(relname == "master", account_name(unit, "replication"))
    )


def credential_gaps(relations: DataFrame, known: DataFrame) -> DataFrame:
    """Accounts ``(cluster, account)`` the relations need for which ``known`` has no password."""
    needed = (
        relations.select("cluster", relation_account(F.col("unit"), F.col("relname")).alias("account"))
        .where(F.col("account").isNotNull())
        .distinct()
    )
    return needed.join(known.select("cluster", "account").distinct(), ["cluster", "account"], "left_anti")


def accounts_to_rename(relations: DataFrame) -> DataFrame:
    """Published accounts that differ from today's naming, as ``(RELATION, old, new)``.

    Both the ``user`` and the ``schema_user`` of a relation now have the relation's account.
    """
    new = relation_account(F.col("service"), F.col("relname"))
    return (
        relations.where(F.col("relname").isin("db", "db-admin"))
        .select(*RELATION, F.explode(F.array("user", "schema_user")).alias("old"), new.alias("new"))
        .where((F.col("old") != "") & (F.col("old") != F.col("new")))
        .distinct()
    )


def unit_order(df: DataFrame, unit: str = "unit") -> DataFrame:
    """Units in natural order, with the sort key spelled out in columns."""
    return df.select(
        "*", service_of(F.col(unit)).alias("service"), unit_number(F.col(unit)).alias("number")
    ).orderBy("service", "number")


def relation_database(relations: DataFrame) -> DataFrame:
    """Database of each relation: asked for, else published, else the client service's name.

    ``all``, published to an administrative relation, is no database's name.
    The remote unit with the lowest number speaks for the relation. Input:
    ``cluster, relname, relid, unit, number, requested, published``.
    """
    bogus = (F.col("relname") == "db-admin") & (F.col("published") == "all")
    named = relations.withColumn("published", F.when(~F.coalesce(bogus, F.lit(False)), F.col("published")))
    first = named.groupBy(*RELATION).agg(
        F.min_by(F.struct("unit", "requested", "published"), F.struct("number", "unit")).alias("_f")
    )
    return first.select(
        *RELATION,
        F.coalesce("_f.requested", "_f.published", service_of(F.col("_f.unit"))).alias("database"),
    )


def mirror(
    units: DataFrame, leaders: DataFrame, keys: Sequence[str] = MIRRORED_KEYS
) -> DataFrame:
    """Give every standby row the leader's published keys.

    ``units(cluster, relname, relid, unit, leader)``; ``leaders(cluster, relname, relid, unit,
    *keys)``.
    Without the leader's row the unit is still waiting.
    """
    source = leaders.select(
        *RELATION, F.col("unit").alias("leader"), *keys, F.lit(True).alias("_found")
    )
    return (
        units.where(F.col("unit") != F.col("leader"))
        .join(source, [*RELATION, "leader"], "left")
        .select(
            *RELATION,
            "unit",
            "leader",
            *keys,
            F.col("_found").isNull().alias("waiting"),
        )
    )


def privilege_plan(relations: DataFrame, config: DataFrame) -> DataFrame:
    """Every configured privilege for each relation's accounts on its database.

    ``relations(cluster, relname, database, user, schema_user)``;
    ``config(cluster, privileges)`` as a comma list. The schema account counts
    only where the relation is not an administrative one.
    """
    privileges = config.select(
        "cluster",
        F.explode(
            F.array_distinct(F.filter(F.split("privileges", ","), lambda p: p != ""))
        ).alias("privilege"),
    )
    plain = F.col("relname") == "db"
    accounts = relations.where(F.col("relname").isin("db", "db-admin", "master")).select(
        "cluster",
        "database",
        F.explode(
            F.array_compact(F.array(F.col("user"), F.when(plain, F.col("schema_user"))))
        ).alias("account"),
    )
    return spread_join(accounts.distinct(), privileges.distinct(), ["cluster"])


def missing_ident(texts: DataFrame, key: str = "unit") -> DataFrame:
    """Required identity-map pairs that no line of a text declares."""
    pairs = F.array(
        *[F.struct(F.lit(s).alias("sysuser"), F.lit(p).alias("pguser")) for s, p in IDENT_PAIRS]
    )

    def declared(p: Column) -> Column:
        wanted = F.array(F.lit(IDENT_MAP), p["sysuser"], p["pguser"])
        return F.exists(F.split("text", "\n"), lambda line: F.split(F.btrim(line, F.lit(BLANKS)), r"\s+") == wanted)

    return texts.select(key, F.explode(F.filter(pairs, lambda p: ~declared(p))).alias("_p")).select(
        key, "_p.sysuser", "_p.pguser"
    )
