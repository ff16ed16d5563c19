"""Fixed schemas of the corpus tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
_TAGS = T.ArrayType(_S)


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


CLIPS = struct(("id", _S), ("audio", _S), ("source_id", _S), ("kind", _S), ("style", _S), ("intensity", _S), ("accent", _S), ("speaker", _S), ("session", _S), ("dur_s", _D), ("text", _S))
QC = struct(("peak_dbfs", _D), ("clip_ratio", _D), ("snr_db", _D), ("dur_s", _D))
TAKES = struct(
    ("id", _S), ("audio", _S), ("text", _S), ("kind", _S), ("style", _S), ("intensity", _S), ("accent", _S), ("speaker", _S), ("session", _S), ("take", _I), ("sr", _I), ("qc", QC), ("ts", _S)
)
CURATION_ITEMS = struct(
    ("id", _S), ("usuario", _S), ("audio", _S), ("text_orig", _S), ("text_v2", _S), ("texto", _S), ("manter", _B), ("flags", _TAGS), ("dur_s", _D), ("editado", _B)
)
EDITS = struct(
    ("id", _S), ("text", _S), ("keep", _B), ("flags", _TAGS), ("emocoes", _TAGS), ("delivery", _TAGS), ("eventos", _TAGS), ("estilo_nl", _S), ("usuario", _S), ("t_start", _D), ("t_end", _D)
)
WORD = struct(("word", _S), ("start", _D), ("end", _D))
MARKER = struct(("t_start", _D), ("t_end", _D), ("tag", _S), ("sev", _S), ("note", _S))
RATINGS = struct(
    ("run", _S), ("id", _S), ("geral", _I), ("nativo", _I), ("natural", _I), ("voz", _I), ("parou", _B), ("carioca", _S), ("nota", _S), ("problemas", _TAGS), ("markers", T.ArrayType(MARKER)), ("ts", _L), ("block", _S)
)
BENCHMARK = struct(("id", _S), ("emotion", _S), ("intensity", _S), ("accent", _S), ("text", _S), ("probe", _S), ("expect", _S), ("tipo", _S), ("traits", _TAGS))
PER_SENTENCE = struct(("id", _S), ("wer", _D), ("dur_s", _D), ("ref", _S), ("hyp", _S))
RUN_RESULTS = struct(
    ("stage", _S), ("run", _S), ("tag", _S), ("source", _S), ("speaker", _S), ("clips", _L), ("lr", _D), ("rank", _I), ("text_mode", _S), ("seed", _L), ("steps", _L), ("wer", _D),
    ("mix", T.MapType(_S, struct(("weight", _D), ("clips", _L), ("used", _L)))), ("holdout", struct(("frac", _D), ("n", _L), ("eval_loss", _D))), ("spk_sim", struct(("mean", _D), ("median", _D))),
)
BASE_MANIFEST = struct(("audio", _S), ("text", _S), ("source", _S), ("license", _S), ("tier", _S), ("shippable", _B), ("dur_s", _D))
DIALOGUES = struct(
    ("id", _S), ("scenario", _S), ("accent", _S), ("turns", T.ArrayType(struct(("spk", _S), ("emotion", _S), ("intensity", _S), ("text", _S), ("bc", _B))))
)
FORMANTS = struct(
    ("speaker_id", _S), ("word", _S), ("vowel_label", _S), ("aperture", _S), ("F1_Hz", _D), ("F2_Hz", _D), ("F3_Hz", _D), ("B1_Hz", _D), ("duration_ms", _D)
)
SIMILARITY = struct(("wav", _S), ("spk_sim", _D))
