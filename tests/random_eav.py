"""Seeded random workflow tables: NULL values and times, time ties, missing attributes,
foreign versions, repeated stages. Used to check the two dimension plans against each other."""

from __future__ import annotations

import datetime as dt
import random

from dimweave.config import ALL, LATEST, MAX_DATE, Attribute, DimensionConfig

RANDOM_ATTRIBUTES = {
    "situacao": Attribute((1,), LATEST, required=True),
    "cliente": Attribute((2,), ALL, required=True),
    "nup": Attribute((3,), ALL, required=True),
    "nurac": Attribute((4,), LATEST),
    "mes_prev": Attribute((5,), LATEST),
    "ano_prev": Attribute((6,), ALL, cast="int"),
    "data_exec": Attribute((7,), ALL, cast="date"),
    "municipio": Attribute((8,), LATEST),
    "uf": Attribute((9,), LATEST),
    "aerodromo": Attribute((10,), LATEST),
    "linha_pta": Attribute((11,), ALL),
    "tp_insp": Attribute((12, 13), ALL),
    "ini_prev": Attribute((14,), MAX_DATE),
    "term_prev": Attribute((15,), MAX_DATE),
}
ELEMENT_NAMES = (
    "Entrada do Processo SEI",
    "Conferir Cadastro",
    "Distribuir Atividade para Execução",
    "Verificar Disponibilidade do Executor",
    "EXECUTAR ATIVIDADE",
    "Fim",
    "Emitir a O.S.",
    "Verificar proposta em andamento",
)
RANDOM_CONFIG = DimensionConfig(
    version=1,
    element_version=1,
    office="BHZ",
    capture_from=100,
    capture_to=101,
    attributes=dict(RANDOM_ATTRIBUTES),
    completed_status="Concluída",
    as_of=dt.datetime(2025, 1, 1),
)


def _text(rng: random.Random, attr_id: int, demand: int):
    if rng.random() < 0.12:
        return None
    if attr_id in (7, 14, 15):
        return (dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(0, 60))).isoformat()
    if attr_id == 6:
        return str(rng.choice([2023, 2024, 2025]))
    if attr_id == 3:
        return f"{demand:05d}.{rng.randrange(3):06d}/{rng.choice([2023, 2024])}-11"
    if attr_id == 2:
        return rng.choice(["SPO/GTREG", "SFI/GTFIS", "SPO/GTFIS"])
    if attr_id == 4:
        return rng.choice(["BHZ", "BHZ", "SAO"])
    if attr_id == 8:
        return rng.choice([" Confins ", "Belo Horizonte", "Lagoa Santa "])
    return rng.choice(["A", "B", "C", "01 - Janeiro", "07 - Julho"])


def random_rows(seed: int, n_demands: int = 40, hot_rows: int = 0) -> dict[str, list[tuple]]:
    """Random tables; with ``hot_rows`` demand 1 also gets that many extra attribute rows
    (spread over all attributes), so one key can hold a large share of the table."""
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    demanda, dado, valor, etapa = [], [], [], []
    elementos = [(100 + i, name, 1) for i, name in enumerate(ELEMENT_NAMES)] + [(200, "Conferir Cadastro", 2)]
    status = [(1, "Em andamento"), (2, "Concluída"), (3, "Cancelada")]
    vid = 0
    sid = 0
    for d in range(1, n_demands + 1):
        demanda.append((d, rng.choice([1, 1, 1, 2]), base + dt.timedelta(hours=d), "user%d" % (d % 3), rng.choice([1, 2, 3])))
        for attr_id in range(1, 16):
            if rng.random() < 0.25:
                continue  # attribute missing for this demand
            for _ in range(rng.choice([1, 1, 2, 3])):
                vid += 1
                valor.append((vid, attr_id, _text(rng, attr_id, d)))
                t = None if rng.random() < 0.1 else base + dt.timedelta(days=rng.randrange(0, 3))  # ties likely
                dado.append((d, vid, t))
        if d == 1:
            for k in range(hot_rows):
                vid += 1
                attr_id = 1 + k % 15
                valor.append((vid, attr_id, _text(rng, attr_id, d)))
                dado.append((d, vid, None if k % 17 == 0 else base + dt.timedelta(minutes=k % 500)))
        for _ in range(rng.choice([0, 1, 2, 3])):
            sid += 1
            el = rng.choice(elementos)[0]
            nxt = rng.choice([None, 101, 102, 105])
            login = rng.choice(["", "", None, "ana", "bia"])
            etapa.append((sid, d, login, el, nxt, None, None, None))
    return {
        "demanda": demanda,
        "demanda_dado": dado,
        "dado_valor": valor,
        "demanda_etapa": etapa,
        "elemento_pn": elementos,
        "status_demanda": status,
    }
