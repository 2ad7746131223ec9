"""Small graphs made by hand."""

from loomgraph import schema
from loomgraph.operators import ingest


def symbol(local_id, name, path="a.ts", kind="function", scope_id=0, type_ref=0, type_name=None, line=1, end_line=1, annotations=()):
    notes = [(a, None, 1) for a in annotations]
    return (path, local_id, name, kind, "global", scope_id, type_ref, type_name, path, line, end_line, None, None, notes, "test")


def call(caller, name, position, path="a.ts", args=(), line=1, condition=None, loop=False, effect="none", target=(None, None)):
    return (path, caller, name, position, list(args), line, condition, loop, effect, None, *target)


def chain(owner, *elements, path="a.ts"):
    return (path, owner, [owner, *elements])


def graph(spark, symbols, chains=(), calls=(), files=()):
    paths = sorted({s[0] for s in symbols})
    return ingest.build(
        spark.createDataFrame(list(symbols), schema.PARSED_SYMBOLS),
        spark.createDataFrame(list(chains), schema.PARSED_CHAINS),
        spark.createDataFrame(list(calls), schema.PARSED_CALLS),
        spark.createDataFrame(list(files) or [(p, "test", 10, 1) for p in paths], schema.FILES),
    )
