"""Column functions for tenancy and access: principals, ACL tests, filters, identity claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def principals(subject: Column, roles: Column) -> Column:
    """The subject (unless blank), then role:<name> for each role."""
    own = F.when(F.trim(subject) != "", F.array(F.trim(subject))).otherwise(F.array().cast("array<string>"))
    named = F.transform(F.filter(roles, lambda r: F.trim(r) != ""), lambda r: F.concat(F.lit("role:"), F.trim(r)))
    return F.concat(own, F.coalesce(named, F.array().cast("array<string>")))


def readable(acl: Column, who: Column) -> Column:
    """Object access: some principal is allowed. No principals or an empty list: denied."""
    return F.coalesce(F.arrays_overlap(acl, who), F.lit(False))


def strict(acl: Column, who: Column, deny_by_default: bool = True) -> Column:
    return F.when(F.coalesce(F.size(acl), F.lit(0)) <= 0, F.lit(not deny_by_default)).otherwise(readable(acl, who))


def any_tag(tags: Column, want: list[str]) -> Column:
    want = [w.strip() for w in want if w.strip()]
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, want))), F.lit(False)) if want else F.lit(True)


def any_source(source: Column, want: list[str]) -> Column:
    want = [w.strip() for w in want if w.strip()]
    return F.trim(source).isin(want) if want else F.lit(True)


def fresh(updated_at: Column, bound: Column) -> Column:
    """Updated at or after the bound; without a (readable) bound all pass."""
    return bound.isNull() | F.coalesce(updated_at >= bound, F.lit(False))


def path_allowed(path: Column, roots: list[str]) -> Column:
    """The path is one of the roots or below one; without roots all are allowed."""
    if not roots:
        return F.lit(True)
    ok = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        ok = ok | (path == root) | F.startswith(path, F.lit(root + "/"))
    return ok


CLAIMS = "sub string, workspace_id string, workspace string, roles array<string>, realm_access struct<roles:array<string>>, scope string"


def claims(payload: Column) -> Column:
    """subject, workspace_id and roles of a token's payload (JSON); null where subject or workspace is missing."""
    x = F.from_json(payload, CLAIMS)
    ws = F.when(F.coalesce(x["workspace_id"], F.lit("")) != "", x["workspace_id"]).otherwise(x["workspace"])
    good = (F.coalesce(x["sub"], F.lit("")) != "") & (F.coalesce(ws, F.lit("")) != "")
    roles = F.coalesce(x["roles"], x["realm_access"]["roles"], F.array().cast("array<string>"))
    return F.when(good, F.struct(x["sub"].alias("subject"), ws.alias("workspace_id"), roles.alias("roles")))


def scopes(payload: Column) -> Column:
    """Scopes of a token's payload: `scope` as text, else `scp` as a list or text."""
    parts = lambda c: F.filter(F.split(c, " "), lambda s: F.trim(s) != "")
    scope = parts(F.get_json_object(payload, "$.scope"))
    scp = F.get_json_object(payload, "$.scp")
    listed = F.filter(F.transform(F.from_json(scp, "array<string>"), lambda s: F.trim(s)), lambda s: s != "")
    empty = F.array().cast("array<string>")
    return F.when(F.size(scope) > 0, scope).when(F.startswith(scp, F.lit("[")), F.coalesce(listed, empty)).otherwise(F.coalesce(parts(scp), empty))


def identity(mode: str, over_http: bool, header: Column, payload: Column, subject: Column, workspace: Column, roles: Column) -> Column:
    """Who calls: (subject, workspace_id, roles, source, error). header and payload are token payloads (JSON; null: none given; unreadable: invalid).

    The header's token comes first, then the payload's, then the subject and workspace that the payload states, else anonymous. Strict modes ask for a
    good header over HTTP; a payload's token does not count in strict_oauth over HTTP.
    """
    strict = mode in ("strict", "strict_oauth") and over_http
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    own, stated = claims(header), claims(payload)
    none = F.array().cast("array<string>")
    result = lambda who, ws, rs, source: F.struct(who.alias("subject"), ws.alias("workspace_id"), F.coalesce(rs, none).alias("roles"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("error"))
    text = F.lit(None).cast("string")
    failed = lambda why: F.struct(text.alias("subject"), text.alias("workspace_id"), F.lit(None).cast("array<string>").alias("roles"), text.alias("source"), F.lit(why).alias("error"))
    by_header = result(own["subject"], own["workspace_id"], own["roles"], "authorization_header")
    if strict:
        return F.when(blank(header) == "", failed("missing_bearer_token")).when(own.isNull(), failed("invalid_bearer_token")).otherwise(by_header)
    by_payload = result(stated["subject"], stated["workspace_id"], stated["roles"], "payload_jwt")
    by_statement = result(blank(subject), blank(workspace), roles, "legacy_acl")
    anonymous = result(F.lit("anonymous"), F.lit("default"), none, "anonymous")
    return F.when(own.isNotNull(), by_header).when(stated.isNotNull(), by_payload).when((blank(subject) != "") & (blank(workspace) != ""), by_statement).otherwise(anonymous)
