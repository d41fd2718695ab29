"""SQL functions: registered in a session, they work in any query of it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from .functions.engine import Engine
from .functions.html import clean_html
from .functions.mime import decode_charset, decoded, parts
from .functions.url import parse
from .rules.packs import load


def register(spark: SparkSession, engine: Engine | None = None) -> list[str]:
    """Register the functions and give their names.

    normal_url(url), clean_url(url), unwrap_url(url), provider_of(url), param_is_tracking(url, name) and
    clean_html(html) in Arrow batches; message_parts(raw) is a table function (place, content_type, charset, encoding,
    attachment, text).
    """
    engine = engine or Engine(load())

    def text(f):
        return pandas_udf(lambda s: s.map(f, na_action="ignore"), "string")

    def on_url(f):
        return text(lambda t: f(u) if (u := parse(t)) else t)

    every = {
        "normal_url": text(lambda t: str(u) if (u := parse(t)) else None),
        "clean_url": on_url(lambda u: engine.clean(u).url),
        "unwrap_url": on_url(lambda u: engine.unwrap(u).url if u.web else str(u)),
        "provider_of": text(lambda t: engine.provider(str(u)) if (u := parse(t)) else None),
        "clean_html": text(lambda t: clean_html(t, engine).html),
        "param_is_tracking": pandas_udf(lambda url, name: pd.Series([bool(u) and n is not None and engine.param_is_tracking(u, n) for u, n in zip(map(parse, url), name)]), "boolean"),
    }
    for name, f in every.items():
        spark.udf.register(name, f)

    class Parts:
        def eval(self, raw: bytes):
            for i, p in enumerate(parts(bytes(raw or b""))):
                yield i + 1, p.ctype, p.charset, p.encoding, p.attachment, decode_charset(decoded(bytes(raw), p), p.charset)

    spark.udtf.register("message_parts", udtf(Parts, returnType="place int, content_type string, charset string, encoding string, attachment boolean, text string"))
    return [*every, "message_parts"]
