"""Configuration files: packages, services, functions, property lists.

JSON, TOML and Gemfiles are read by column expressions. Compose, SAM and serverless
files are states that run down the lines; they use ``aggregate`` over the lines of a
file. Property lists may be binary and go through an Arrow function.
"""

from __future__ import annotations

import plistlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PACKAGE = "name string, description string, version string, dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>"


def package_json(content: Column) -> Column:
    """struct(ok, name, description, version, dependencies, scripts); ok: the text is a JSON object."""
    data = F.from_json(content, PACKAGE)
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    ok = F.typeof(F.try_parse_json(content)).isNotNull() & F.try_parse_json(content).isNotNull()
    return F.struct(
        ok.alias("ok"), data["name"].alias("name"), data["description"].alias("description"), data["version"].alias("version"),
        F.array_sort(F.array_distinct(F.concat(keys(data["dependencies"]), keys(data["devDependencies"])))).alias("dependencies"), keys(data["scripts"]).alias("scripts"),
    )


def _state(content: Column, start: Column, step) -> Column:
    return F.aggregate(F.split(content, "\n", -1), start, step)


def cargo_toml(content: Column) -> Column:
    """struct(name, dependencies)."""
    name = T.find(content, r'^\[package\]\s*\n(?:.*\n)*?name\s*=\s*"([^"]+)"', 1, "m")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, line: Column) -> Column:
        opens = T.has(line, r"^\[(?:.*)?dependencies(?:\.\w+)?\]")
        inside = F.when(opens, True).when(line.startswith("["), False).otherwise(s["inside"])
        key = T.find(line, r"^(\w[\w-]*)\s*=")
        found = F.when(~opens & inside & key.isNotNull(), F.concat(s["found"], F.array(key))).otherwise(s["found"])
        return F.struct(inside.alias("inside"), found.alias("found"))

    return F.struct(name.alias("name"), _state(content, start, step)["found"].alias("dependencies"))


def pyproject_toml(content: Column) -> Column:
    """struct(name, dependencies)."""
    found = F.filter(T.find_all(content, r'"([\w-]+)(?:[><=!~]|$)'), lambda d: d != "python")
    return F.struct(T.find(content, r'name\s*=\s*"([^"]+)"').alias("name"), found.alias("dependencies"))


def gemfile(content: Column) -> Column:
    """Gems, distinct and ascending."""
    return F.array_sort(F.array_distinct(T.find_all(content, r"""gem\s+['"]([^'"]+)['"]""")))


def ruby_app_name(application_rb: Column, config_ru: Column, rakefile: Column) -> Column:
    """A Rails or Rack application's name in words, from the first file that names it."""
    name = F.coalesce(T.find(application_rb, r"module\s+(\w+)"), T.find(config_ru, r"run\s+(\w+)::Application"), T.find(rakefile, r"(\w+)::Application\.load_tasks"))
    return T.spaced(name)


def docker_compose(content: Column) -> Column:
    """struct(services, ports: array of struct(service, host, container))."""
    port = "struct<service:string,host:int,container:int>"
    start = F.struct(
        F.lit(False).alias("in_services"), F.lit(False).alias("in_ports"), F.lit(None).cast("string").alias("service"), F.array().cast("array<string>").alias("services"), F.array().cast(f"array<{port}>").alias("ports")
    )

    def step(s: Column, line: Column) -> Column:
        bare = T.stripped(line)
        begins = bare == "services:"
        leaves = s["in_services"] & ~line.startswith(" ") & (bare != "") & ~line.startswith("#")
        inside = F.when(begins, True).when(leaves, False).otherwise(s["in_services"])
        works = inside & ~begins
        name = T.find(line, r"^  (\w[\w-]*):")
        named = works & name.isNotNull()
        heads = works & line.contains("ports:")
        was = F.when(named, False).otherwise(s["in_ports"])
        item = works & ~heads & was & bare.startswith("-")
        host, container = T.find(line, r"(\d+):(\d+)", 1), T.find(line, r"(\d+):(\d+)", 2)
        service = F.when(named, name).otherwise(s["service"])
        made = F.struct(service.alias("service"), host.try_cast("int").alias("host"), container.try_cast("int").alias("container"))
        return F.struct(
            inside.alias("in_services"),
            F.when(~works, s["in_ports"]).when(heads, True).when(was & ~bare.startswith("-"), False).otherwise(was).alias("in_ports"),
            service.alias("service"),
            F.when(named, F.concat(s["services"], F.array(name))).otherwise(s["services"]).alias("services"),
            F.when(item & host.isNotNull(), F.concat(s["ports"], F.array(made).cast(f"array<{port}>"))).otherwise(s["ports"]).alias("ports"),
        )

    done = _state(content, start, step)
    return F.struct(done["services"].alias("services"), done["ports"].alias("ports"))


_FUNCTION = "struct<name:string,runtime:string,handler:string,code_uri:string>"


def sam_template(content: Column) -> Column:
    """struct(functions, has_api_gateway, type)."""
    text = lambda: F.lit(None).cast("string")
    resource = F.struct(text().alias("name"), text().alias("type"), text().alias("runtime"), text().alias("handler"), text().alias("code_uri"))
    kind = "struct<name:string,type:string,runtime:string,handler:string,code_uri:string>"
    start = F.struct(F.lit(False).alias("inside"), F.lit("").alias("unused"), resource.cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("done"))

    def step(s: Column, line: Column) -> Column:
        bare = T.stripped(line)
        counts = (bare != "") & ~bare.startswith("#")
        begins = bare == "Resources:"
        leaves = s["inside"] & ~line.startswith(" ") & bare.endswith(":")
        inside = F.when(~counts, s["inside"]).when(begins, True).when(leaves, False).otherwise(s["inside"])
        works = counts & inside & ~begins
        name = T.find(line, r"^  (\w[\w-]*):")
        named = works & name.isNotNull()
        value = lambda key, old: F.when(works & T.has(bare, key + r":\s*(.+)"), T.stripped(F.regexp_extract(bare, T.java(key + r":\s*(.+)"), 1))).otherwise(old)
        now = F.struct(
            F.when(named, name).otherwise(s["now"]["name"]).alias("name"),
            *[F.when(named, text()).otherwise(value(key, s["now"][field])).alias(field) for key, field in (("Type", "type"), ("Runtime", "runtime"), ("Handler", "handler"), ("CodeUri", "code_uri"))],
        )
        done = F.when(named & s["now"]["name"].isNotNull(), F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        return F.struct(inside.alias("inside"), s["unused"].alias("unused"), now.cast(kind).alias("now"), done.alias("done"))

    end = _state(content, start, step)
    all_ = F.when(end["now"]["name"].isNotNull(), F.concat(end["done"], F.array(end["now"]))).otherwise(end["done"])
    blank = lambda c: F.coalesce(c, F.lit(""))
    functions = F.transform(F.filter(all_, lambda r: F.coalesce(r["type"].contains("Function"), F.lit(False))), lambda r: F.struct(r["name"].alias("name"), blank(r["runtime"]).alias("runtime"), blank(r["handler"]).alias("handler"), blank(r["code_uri"]).alias("code_uri")))
    return F.struct(functions.cast(f"array<{_FUNCTION}>").alias("functions"), T.has(content, r"AWS::Serverless::Api|AWS::ApiGateway").alias("has_api_gateway"), F.lit("sam").alias("type"))


def serverless_yml(content: Column) -> Column:
    """struct(functions, provider, type)."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, line: Column) -> Column:
        bare = T.stripped(line)
        begins = bare == "functions:"
        inside = F.when(begins, True).when(s["inside"] & ~line.startswith(" ") & bare.endswith(":"), False).otherwise(s["inside"])
        name = T.find(line, r"^  (\w[\w-]*):")
        return F.struct(inside.alias("inside"), F.when(inside & ~begins & name.isNotNull(), F.concat(s["found"], F.array(name))).otherwise(s["found"]).alias("found"))

    names = _state(content, start, step)["found"]
    functions = F.transform(names, lambda n: F.struct(n.alias("name"), *[F.lit(None).cast("string").alias(k) for k in ("runtime", "handler", "code_uri")]))
    return F.struct(functions.cast(f"array<{_FUNCTION}>").alias("functions"), F.coalesce(T.find(content, r"provider:\s*\n\s+name:\s*(\w+)"), F.lit("")).alias("provider"), F.lit("serverless").alias("type"))


def _plists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, bundles = [], []
        for raw in b.column(2).to_pylist():
            try:
                data = plistlib.loads(raw)
                name = data.get("CFBundleDisplayName") or data.get("CFBundleName") or ""
                names.append("" if "$(" in name or "${" in name else name)
                bundles.append(data.get("CFBundleIdentifier", ""))
            except Exception:  # any broken property list has no name
                names.append(None)
                bundles.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(bundles, pa.string())], names=["repo", "path", "plist_name", "bundle_id"])


def info_plists(entries: DataFrame) -> DataFrame:
    """(repo, path, plist_name, bundle_id) of the tree's ``Info.plist`` files (content in bytes)."""
    return entries.where("name = 'Info.plist' and content is not null").select("repo", "path", F.col("content").cast("binary")).mapInArrow(_plists, "repo string, path string, plist_name string, bundle_id string")
