"""Fixed values of the matchers: vocabularies, patterns and weights, in their order of precedence."""

from __future__ import annotations

#: Patterns are case-insensitive; the first that is found gives the value.
REGIONS = [("antebrazo|a\\.?\\s*brazo", "antebrazo"), ("brazo|br\\.?", "brazo"), ("espalda|esp\\.?", "espalda"), ("pecho|torax|tórax", "pecho"), ("pierna|pna", "pierna"), ("mano|mno", "mano"), ("cuello|cllo", "cuello"), ("cabeza", "cabeza"), ("cara|rostro", "cara"), ("cadera", "cadera"), ("muslo", "muslo"), ("rodilla", "rodilla"), ("tobillo", "tobillo"), ("pie", "pie"), ("gluteo|glúteo", "gluteo"), ("hombro", "hombro"), ("abdomen", "abdomen"), ("dedo", "dedo")]
SIDES = [("izquierd|izq", "izquierda"), ("derech|der", "derecha"), ("bilateral|bil", "bilateral"), ("central|cen", "central")]
MOTIFS = [("ancla|ancora|nautic", "nautico"), ("cruz|virgen|guadalupe|jesus|jesús|santo|cristo|religios", "religioso"), ("rosa|flor|rosita|girasol|tulipan", "floral"), ("leon|león|aguila|águila|perro|gato|caballo|serpiente|tigre|lobo|animal", "animal"), ("nombre|maria|maría|juan|nombre_texto", "nombre_texto"), ("fecha|\\d{1,2}/\\d{1,2}/?\\d*", "fecha_numero"), ("estrella|corazon|corazón|calavera|simbolo|símbolo|trebol|trébol", "simbolo"), ("retrato|cara de|rostro de", "retrato"), ("tribal|polinesio|maori|maorí", "tribal"), ("escudo|america|américa|chivas|futbol|fútbol|deport", "deportivo"), ("marin|ejercito|ejército|militar|armad", "militar")]
TYPES = [("tatuaj|tato|tatu", "tatuaje"), ("cicatri|cic|herida|marca de|quemadura", "cicatriz"), ("lunar", "lunar"), ("piercing|arete|argolla", "piercing"), ("protesis|prótesis", "protesis"), ("amputac", "amputacion"), ("dental|diente|mordida", "dental"), ("vestimenta|ropa|playera|pantal", "vestimenta")]
#: Whole-word sides, for strict classification: a hip is no right side.
STRICT_SIDES = [("(?<![a-z])(izquierd[oa]|izq)(?![a-z])", "izquierda"), ("(?<![a-z])(derech[oa]|der)(?![a-z])", "derecha"), ("(?<![a-z])(bilateral|bil)(?![a-z])", "bilateral"), ("(?<![a-z])(central|cen)(?![a-z])", "central")]
CLUSTERS = {"ARM": ["brazo", "antebrazo", "mano", "dedo", "hombro"], "LEG": ["pierna", "muslo", "rodilla", "tobillo", "pie"], "TORSO": ["pecho", "espalda", "abdomen", "cadera", "gluteo"], "HEAD": ["cabeza", "cara", "cuello"]}
STOP_A = ["de", "en", "el", "la", "los", "las", "del", "con", "y", "a", "un", "una"]
STOP_B = ["LADO", "O", "Y", "DE", "DEL", "EL", "LA", "EN", "CON"]
SIDES_B = {"IZQ": ["IZQUIERDO", "IZQUIERDA", "IZQ"], "DER": ["DERECHO", "DERECHA", "DER"]}
FORBIDDEN = ["culpable", "plaza de x en esta calle", "plaza de ", "este caso está conectado", "este caso esta conectado", "confirmado por ia", "confirmado por la ia"]
RECOMMENDED = ["posible patrón", "señal contextual", "pendiente de revisión", "pendiente de revision", "no constituye conclusión", "no constituye conclusion", "fuente pública/autorizada", "fuente publica/autorizada"]
TONES = [("payment_request", "pago|cuota|costo|deposito|fee|payment|deposit|inversion"), ("urgency", "urgente|inmediato|hoy|limited|secret"), ("off_platform_contact", "whatsapp|telegram|signal"), ("data_harvest", "ine|curp|rfc|documento|datos personales"), ("job_offer", "buscamos|se necesita|vacante|empleo|trabajo"), ("high_salary", "(\\$|pesos)\\s*\\d{4,}|sueldo"), ("vague_company", "grupo empresarial|empresa líder|compañía reconocida"), ("immediate_start", "inmediato|mañana|inicia hoy"), ("uniform_fee", "uniforme|credencial|gafete"), ("investment_return", "invierte|rendimiento|retorno|ganancia"), ("crypto", "bitcoin|crypto|usdt|binance"), ("delivery_job", "repartidor|domicilios|uber|rappi|didi")]
SHORT_TONES = [("urgency", "urgente|inmediato|hoy"), ("job_offer", "trabajo|empleo|vacante"), ("payment_request", "pago|cuota|deposito|transferencia"), ("off_platform_contact", "whatsapp|telegram"), ("data_harvest", "datos|ine|curp|documento"), ("high_salary", "\\$\\s*\\d{4,}")]
TRIGGERS = "pago|cuota|costo|inversion|deposito|transferen|fee|payment|deposit|urgente|inmediato|hoy(\\s+mismo)?|limited|secret|whatsapp only|solo whatsapp|telegram|signal|datos personales|ine|curp|rfc|documento"
RISK_WORDS = "trabajo|empleo|vacante|sueldo|buen dinero|sin experiencia|norte|cruzar|levant|secuestr|trata|enganche|reclut"
#: State names as an upper-casing source leaves them, and as they are written; in the order of replacement.
STATE_REPAIRS = [("MEXICO", "MÉXICO"), ("LEON", "LEÓN"), ("MICHOACAN", "MICHOACÁN"), ("QUERETARO", "QUERÉTARO"), ("POTOSI", "POTOSÍ"), ("YUCATAN", "YUCATÁN")]
#: id, category, severity and patterns of the offer signals that are plain pattern lists, in report order (None: computed). Case does not
#: count; \b is an edge between ASCII letters, digits or _ and anything else.
SIGNALS = [
    ("no_experiencia", "texto", "medium", ["sin\\s+experiencia", "no\\s+(se\\s+)?requiere\\s+experiencia", "cero\\s+experiencia", "no\\s+experiencia", "principiantes\\s+bienvenidos"]),
    ("contratacion_inmediata", "texto", "high", ["contrataci[oó]n\\s+inmediata", "inmediato", "urgente", "same\\s+day", "inicio\\s+hoy", "ya\\s+mismo"]),
    ("salario_inusual", "texto", "medium", None),
    ("prestaciones_excesivas", "texto", "info", None),
    ("contacto_otra_ciudad", "contexto", "high", None),
    ("errores_ortograficos", "texto", "info", ["q\\s+haya", "\\bx\\b\\s+q", "empleo\\s+garantisado", "sireria", "nesesita", "aventa", "aseptamos"]),
    ("pide_dinero_documentos", "texto", "critical", ["paga\\s+(cuota|dep[oó]sito|fianza|cooperaci[oó]n)", "dep[oó]sito\\s+(de\\s+)?garant[ií]a", "env[ií]a\\s+(tu\\s+)?ine", "manda\\s+(tu\\s+)?ine", "requerimos\\s+(tu\\s+)?rfc", "cuota\\s+de\\s+inscripci[oó]n"]),
    ("ubicacion_sospechosa", "contexto", "high", ["central\\s+(nueva|vieja|de\\s+autobuses|camionera)", "terminal\\s+(de\\s+)?(autobuses|camionera)", "hotel\\s+(riu|aranzaz[uú])", "\\bcasa\\s+particular\\b", "domicilio\\s+particular", "central\\s+de\\s+(gdl|guadalajara)"]),
    ("transporte_entrevista", "texto", "high", ["te\\s+mandamos\\s+(un\\s+)?uber", "te\\s+pagamos\\s+(el|un)\\s+(uber|didi|taxi)", "enviamos\\s+(uber|didi)", "te\\s+reservamos\\s+(el|un)\\s+(uber|didi)"]),
    ("agencia_modelaje", "texto", "high", ["agencia\\s+de\\s+modelaje", "modelos?\\s+(femeninas?|buscamos)", "sesi[oó]n\\s+(de\\s+)?fotos?\\s+paga", "casting\\s+(de\\s+)?modelos"]),
    ("codigos_visuales_crimen", "visual", "high", ["\\bninja\\b", "\\bgallo\\b", "\\bpizza\\b", "tr[eé]bol", "ojo\\s+turco", "ogro\\s+japon[eé]s", "casco\\s+militar", "\\bb[uú]ho\\b"]),
    ("perfiles_lure", "texto", "info", ["call\\s*center", "asesor\\s+(de\\s+)?ventas", "almacenista", "guardia\\s+(de\\s+)?seguridad", "personal\\s+de\\s+limpieza", "auxiliar\\s+general"]),
    ("perfiles_tecnicos_crimen", "texto", "medium", ["qu[ií]mico", "\\bplomer", "electricista", "(m[eé]dico|enfermer[oa]|enfermer[ií]a)", "ingenier[oi]a\\s+(en\\s+)?telecomunicaciones", "instalador\\s+de\\s+(antenas|radios)"]),
    ("diseno_generico", "visual", "info", None),
]
SEVERITY = {"info": 8, "medium": 18, "high": 32, "critical": 45}
BENEFITS = "prestaciones|seguro social|infonavit|vales|aguinaldo|utilidades|bonos|vacaciones"
