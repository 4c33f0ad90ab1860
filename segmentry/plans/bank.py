"""Preset for bank transactions: one row per transaction, customer columns repeated."""

from __future__ import annotations

from ..spec import DatasetSpec, LabelGroups

# The columns of the raw files, in file order, and what they hold.
COLUMNS = {
    "cli": "customer id",
    "tipo_cli": "customer type",
    "estado_cli": "customer status",
    "nivel_academico": "education level",
    "profn": "profession",
    "ocup": "occupation",
    "tipo_contrato": "employment contract type",
    "genero_cli": "gender",
    "tipo_vivienda": "housing type",
    "pais_nacim": "country of birth",
    "ing_mes": "monthly income",
    "egresos_mes": "monthly expenses",
    "origen_fondos": "source of funds",
    "operac_moneda_extranjera": "operates in foreign currency",
    "ciiu": "economic activity",
    "nivel_riesgo_ciiu": "risk level of the economic activity",
    "sociedad_ccial_civ": "company type",
    "mun_res": "municipality of residence",
    "score_riesgo_mun": "risk score of the municipality",
    "trn_desc_tip_cta": "account type of the transaction",
    "trn_oper": "kind of operation",
    "trn_monto": "transaction amount",
    "trn_efec": "cash transaction",
    "trn_canal_serv_efec": "channel of the cash transaction",
}

# The labels that become 0/1 features.
DUMMIES = {
    "tipo_cli": ["persona natural"],
    "estado_cli": ["activo", "inactivo"],
    "nivel_academico": ["None", "universitario", "bachiller", "no informa", "tecnologo", "especializacion"],
    "tipo_contrato": ["None", "termino indefinido", "no informa/no tiene"],
    "genero_cli": ["m", "f"],
    "tipo_vivienda": ["None", "familiar", "propia", "alquilada", "no informa"],
    "pais_nacim": ["colombia"],
    "operac_moneda_extranjera": ["n"],
    "nivel_riesgo_ciiu": ["None", "bajo", "medio", "alto"],
    "trn_desc_tip_cta": ["ahorro", "corriente"],
    "trn_efec": ["no", "None", "si"],
    "trn_canal_serv_efec": ["sin informacion", "None", "corresponsal bancario", "cajero"],
    "mun_res": ["bogota d.c.", "medellin", "cali", "Other", "None"],
    "trn_oper": ["credit", "debit"],
}

# Occupations by group; all others belong to "Others".
OCCUPATIONS = {
    "Professionals": ["profesional independiente", "socio o empleado - socio"],
    "Self-employed": ["independiente", "comerciante", "rentista de capital", "agricultor", "ganadero"],
    "Non-working": [
        "pensionado", "ama de casa", "estudiante", "desempleado con ingresos", "desempleado sin ingresos",
    ],
    "Others": ["None", "otra"],
}

# Professions by group; all others belong to "Others".
PROFESSIONS = {
    "STEM": [
        "ingenieria de sistemas", "ingenieria industrial", "ingenieria civil", "ingenieria mecanica",
        "ingeniero electronico", "ingenieria electrica", "tecnologia sistemas", "ingeniria quimica",
        "tecnologia electricidad", "tecnologia mecanica", "tecnologia industrial", "ingenieria ambiental",
        "ingenieria administrativa", "biologia", "ingenieria de petroleos", "tecnologia agropecuaria",
        "ingenieria agricola", "ingenieria financiera", "tecnologia en construccion", "geologia",
        "ingenieria forestal", "ingenieria de minas", "ingenieria sanitaria", "ingeniero metalurgico",
        "tecnologia en minas", "arquitectura", "agronomia",
    ],
    "Health & Medicine": [
        "medicina", "enfermeria", "odontologia", "quimica farmaceutica", "nutricion y dietetica",
        "auxiliar de enfermeria", "regencia de farmacia", "auxiliar de odontologia",
        "operaciones de equipos medicos", "tecnologia en ciencias de la salud", "veterinaria", "bacteriologia",
    ],
    "Business, Law & Administration": [
        "administracion", "contaduria", "derecho", "economia", "auxiliar contable", "mercadotecnia",
        "comercio internacional", "secretariado", "tecnologia en administracion", "transportador",
        "carrera militar", "pilotos", "azafata",
    ],
    "Arts, Humanities & Social Sciences": [
        "educacion", "psicologia", "comunicacion social", "diseño y publicidad", "artes", "trabajo social",
        "profesores de educacion primaria", "profesores de educacion preescolar", "sociologia",
        "filosofia y letras", "deportistas entrenadores tecnicos deport",
        "musicos artistas empresarios y prud espect", "escritores periodistas y trabajadores simil",
        "fotografos y operadores de camara cine y tv", "escultores pintores fotografos y art simi",
        "sacerdote", "religiosa",
    ],
}

NUMERIC = ["ing_mes", "egresos_mes", "score_riesgo_mun", "trn_monto"]
EVENT_COLUMNS = ["trn_desc_tip_cta", "trn_oper", "trn_monto", "trn_efec", "trn_canal_serv_efec"]

BANK = DatasetSpec(
    entity="cli",
    columns=COLUMNS,
    numeric=NUMERIC,
    entity_columns=[c for c in COLUMNS if c not in EVENT_COLUMNS],
    amount="trn_monto",
    income="ing_mes",
    expenses="egresos_mes",
    cash=("trn_efec", "si"),
    location="mun_res",
    risk_level="nivel_riesgo_ciiu",
    risk_scores={"alto": 3, "medio": 2},
    dummies=DUMMIES,
    label_groups=[
        LabelGroups("ocup", "ocup_category", OCCUPATIONS),
        LabelGroups("profn", "profn_category", PROFESSIONS),
    ],
    keep_labels=["cli", "profn", "ocup", "nivel_riesgo_ciiu"],
    profiled_categories=[
        "tipo_cli", "estado_cli", "nivel_academico", "profn", "ocup", "tipo_contrato", "genero_cli",
        "tipo_vivienda", "pais_nacim", "operac_moneda_extranjera", "nivel_riesgo_ciiu",
        "trn_desc_tip_cta", "trn_efec", "trn_canal_serv_efec",
    ],
)
