"""Closed vocabularies of the citation rules: data only."""

from __future__ import annotations

# Forms under which a class of proceedings is cited. A space may be any white space.
CLASS_FORMS = [
    "Embargos de Declaração", "EDcl", "ED", "Embargos de Divergência", "Agravo Regimental", "AgRg", "Ag. Rg",
    "AG. REG.", "Terceiro AG. REG", "Agravo Interno", "AgInt", "Ag. Int.", "Agravo em Recurso Especial", "AREsp",
    "AgREsp", "Agravo em Recurso Extraordinário", "ARE", "AgREx", "AG.REX", "Agravo de Instrumento", "AI", "AgR-AI",
    "Agravo", "Recurso Especial Eleitoral", "REspe", "AgR-REspe", "AREspEl", "AREspEI", "Recurso Especial", "REsp",
    "R. Esp.", "Rec. Esp.", "Recurso Extraordinário", "REX", "RE", "Recurso em Habeas Corpus", "RHC", "RHAB",
    "Recurso Ordinário", "RO", "Recurso de Revista", "RR", "Recurso em Mandado de Segurança", "RMS", "Reclamação",
    "Recl.", "Rcl", "Apelação", "APL", "Recurso em Sentido Estrito", "RSE", "Habeas Corpus", "HC", "H.C.",
    "Ação Rescisória", "AR", "AC. RES.", "Mandado de Segurança", "MS", "Suspensão de Liminar e de Sentença", "SLS",
    "SL", "AgARR", "ARR", "Agravo de Instrumento em Recurso de Revista", "AIRR", "AgI/RR", "AG.I/RR", "R-Rp",
    "Recurso na Representação", "Representação", "RRep", "Ação de Investigação Judicial Eleitoral", "AIJE",
    "Conflito de Jurisdição",
]
# Words that join classes.
CONNECTORS = ["o", "a", "os", "as", "no", "na", "nos", "nas"]
# Signs of an ordinal; of these the letters that count as signs, not as letters.
ORDINAL_SIGNS, ORDINALS = ["º", "o", "°", "."], "ºª"
# Signs that may stand between the digits of a number, besides white space, and how many in a row.
NUMBER_SIGNS, MOST_SIGNS = ".-/°ºo", 3
# Letters that OCR puts for digits, those that may also go on a number, and their digits.
OCR_LETTERS, OCR_MORE, OCR_DIGITS = "OoIlSs", "OoIlSsgG", str.maketrans("OoIlSsg", "0011559")
# Words before a document's own number, and before numbers that are no citation.
OWN_NUMBER = ["processo", "autos", "protocolo"]
OTHER_NUMBER = ["cnpj", "cpf", "rg", "cep", "matricula", "telefone", "fax", "oab"]
# Signs before the two letters of a state.
STATE_SIGNS = "/-–—("
# Words that may follow a class.
QUALIFIERS = ["Eleitoral", "Criminal", "Cível", "Trabalhista", "Militar", "Previdenciário", "Tributário", "Ordinária"]
# Courts.
COURTS = ["STF", "STJ", "TST", "TSE", "STM"]
# What a decision is called, and how one was handed down in a year, with misreadings of c for e.
DECISIONS = ["julgado", "precedente", "acordao"]
DECIDED_IN = ["proferido", "proferida", "profcrido", "profcrida", "julgado", "julgada"]
# Names of codes.
CODES: dict[str, list[str]] = {
    "cpc": ["cpc", "codigo de processo civil", "lei 13.105/2015"],
    "cdc": ["cdc", "codigo de defesa do consumidor"],
    "clt": ["clt", "consolidacao das leis do trabalho"],
    "cf": ["cf", "cf/88", "constituicao federal", "constituicao da republica", "constituicao"],
    "cpm": ["cpm", "codigo penal militar"],
    "cpp": ["cpp", "codigo de processo penal"],
    "cc": ["cc", "codigo civil"],
    "codigo_eleitoral": ["codigo eleitoral"],
    "lc64_1990": ["lc 64/1990", "lc 64", "lei complementar 64/1990", "lei complementar 64", "lei no 64/1990"],
}
# Code to which an article of the registry belongs.
ARTICLE_CODES = {1: "lc64_1990", 5: "cf", 7: "cf", 14: "cdc", 93: "cf", 186: "cc", 276: "codigo_eleitoral", 290: "cpm", 312: "cpp", 373: "cpc", 477: "clt", 818: "clt", 896: "clt"}
# Numbers of precedents whose text doesn't name them, by court.
KNOWN_PRECEDENTS = {"STF": 10, "TST": 331}
# Forms of a class that may stand for one another.
SYNONYMS: dict[str, list[str]] = {
    "agravo_regimental": ["AgRg", "Ag. Rg.", "AG.REG.", "Agravo Regimental"],
    "agravo_interno": ["AgInt", "Ag. Int.", "Agravo Interno"],
    "agravo_em_resp": ["AREsp", "A.REsp", "AgREsp", "Agravo em Recurso Especial"],
    "agravo_em_re": ["ARE", "AgREx", "Agravo em Recurso Extraordinário"],
    "resp": ["REsp", "R.Esp.", "Rec. Esp.", "Recurso Especial"],
    "re": ["RE", "REX", "Recurso Extraordinário"],
    "rhc": ["RHC", "RHAB", "Recurso em Habeas Corpus"],
    "rcl": ["Rcl", "Recl.", "RCL", "Reclamação"],
    "apl": ["APL", "Apelação"],
    "hc": ["HC", "H.C.", "Habeas Corpus"],
    "ar": ["AR", "AC.RES.", "Ação Rescisória"],
    "ms": ["MS", "Mandado de Segurança"],
}
# Vague mentions of precedents and of laws.
VAGUE_PRECEDENTS = [
    "jurisprudência pacífica desta Corte",
    "entendimento sumulado sobre a matéria",
    "verbete sumular aplicável à espécie",
    "orientação jurisprudencial da Corte Superior",
    "precedentes desta Casa em situações análogas",
    "reiterados precedentes do Superior Tribunal de Justiça",
    "precedente firmado em sede de recurso repetitivo",
    "jurisprudência consolidada dos tribunais superiores",
    "recente acórdão da Segunda Turma",
    "entendimento pacificado deste Tribunal",
    "posição consolidada desta Corte",
    "entendimento consolidado nas Cortes Superiores",
    "linha decisória consolidada da Corte",
    "orientação jurisprudencial deste Tribunal Superior",
    "tese fixada em súmula aplicável ao caso",
    "verbete sumular pertinente à lide",
    "entendimento cristalizado em súmula aplicável",
    "precedentes desta Corte em casos análogos",
    "entendimento firmado em situações semelhantes",
    "tese firmada em julgamento de recursos repetitivos",
    "acórdão recente da Segunda Turma",
]
VAGUE_LAWS = [
    "normas de regência da matéria",
    "dispositivo constitucional invocado na origem",
    "dispositivo legal de regência",
    "legislação de regência da matéria",
    "artigo correspondente do Código de Processo Civil",
    "lei que disciplina a prescrição no caso",
    "normas aplicáveis ao tema em análise",
    "dispositivos legais pertinentes à questão",
    "preceito constitucional invocado na origem",
    "norma constitucional suscitada na petição inicial",
    "dispositivo do Código de Processo Civil pertinente ao caso",
    "ordenamento jurídico aplicável à questão",
]
# Words that give an English text away.
ENGLISH_HINTS = ["the", "of", "in", "for", "law", "laws", "case", "legal", "regulation", "regulations", "framework", "guidelines", "and", "is", "are", "this", "that", "establishing", "procedure", "procedures", "provisions", "governing", "material", "measures", "specific", "related", "through", "formalized", "formalization", "instructions", "aspects", "issues"]
# Classes no rule lists, name and short form.
UNSEEN_CLASSES = [
    ("Ação Direta de Inconstitucionalidade", "ADI"),
    ("Arguição de Descumprimento de Preceito Fundamental", "ADPF"),
    ("Ação Declaratória de Constitucionalidade", "ADC"),
    ("Mandado de Injunção", "MI"),
    ("Habeas Data", "HD"),
    ("Conflito de Competência", "CC"),
    ("Revisão Criminal", "RvCr"),
    ("Recurso de Reexame Necessário", "RReN"),
    ("Agravo de Execução", "AgExec"),
]
