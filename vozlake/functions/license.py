"""License and tier rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licence substrings.
SHIP_OK = ["cc-by-4", "cc-by-3", "cc0", "mit", "apache", "própria", "propria"]
SHIP_BLOCK = ["-nc", "nc-", "noncomm", "-nd", "nd-", "sem licença", "sem licenca", "pago", "bloqueado"]
RESEARCH_BLOCK = ["sem acesso", "sem dado", "bloqueado", "pago", "elra"]
DNSMOS_MIN = 3.0


def _any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def commercial_ok(license: Column) -> Column:
    """True when the licence allows product use."""
    low = F.lower(F.coalesce(license, F.lit("")))
    blocked = _any(low, SHIP_BLOCK) | _any(low, ["nc", "nd"])
    return ~blocked & _any(low, SHIP_OK)


def research_ok(license: Column) -> Column:
    """True when the data can be used for research at all."""
    return ~_any(F.lower(F.coalesce(license, F.lit(""))), RESEARCH_BLOCK)


def tier(license: Column, accent: Column, kind: Column, dnsmos: Column, consent: Column) -> Column:
    """Struct (tier, layer, shippable, reason); the first gate that decides wins."""
    acc, knd = F.lower(F.coalesce(accent, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    low = F.lower(F.coalesce(license, F.lit("")))

    def verdict(name: str, layer: str, shippable: bool, reason) -> Column:
        reason = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(
            F.lit(name).alias("tier"), F.lit(layer).alias("layer"), F.lit(shippable).alias("shippable"), reason.alias("reason")
        )

    personal = (F.contains(F.concat(knd, acc), F.lit("judicial")) | F.contains(knd, F.lit("biometr"))) & ~F.coalesce(
        consent, F.lit(False)
    )
    weak = F.concat(F.lit("DNSMOS "), dnsmos.cast("string"), F.lit("<3.0: ASR-grade → só língua"))
    return (
        F.when(
            ~commercial_ok(license),
            verdict("T2 eval-only / T3 judge-only", "fora de pesos", False, "licença NC/ND/sem — só eval/judge/receita"),
        )
        .when(personal, verdict("T4 bloqueado", "nenhuma", False, "LGPD: voz pessoal sem consentimento"))
        .when(F.coalesce(dnsmos < DNSMOS_MIN, F.lit(False)), verdict("T0 base-pretrain", "Camada 0 (língua)", True, weak))
        .when(
            F.contains(acc, F.lit("carioca")) | F.contains(low, F.lit("própr")),
            verdict("T1 fine-tune-voz", "Camada 2 (voz carioca)", True, "carioca commercial-safe → voz"),
        )
        .when(
            _any(knd, ["espont", "convers", "diálogo"]),
            verdict("T1 fine-tune", "Camada 1 (conversa)", True, "espontâneo licenciado → adapt conversacional"),
        )
        .otherwise(verdict("T0 base-pretrain", "Camada 0 (língua)", True, "lido/licenciado → base-PT (língua)"))
    )
