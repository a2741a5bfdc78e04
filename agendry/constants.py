"""Fixed values of the catalogue's rules: word lists, rosters and taxonomies that results depend on."""

NOW = 1705276800  # 2024-01-15T00:00Z; rules take it as a parameter
SESSION_WINDOW = 3600
DAY = 86_400
LISBON = "Europe/Lisbon"

# Sources in order of trust for times; others come last.
TRUST = ("leiriagenda", "eventbrite", "ticketline", "shotgun", "bol", "cmleiriarss", "viralagenda")

VENUE_PREFIXES = ("Centro Cultural ", "Galeria de Arte da ", "Centro de Atividades da ")
VENUE_STOPWORDS = "de da do das dos e em no na o a os as para com the of".split()
GENERIC_VENUE_WORDS = "municipal municipais cidade concelho distrito vila varios varias espacos espaco culturais cultural locais local online desconhecido".split()
CITY_FILLERS = "e arredores arredor regiao zona concelho distrito".split()
DISTRICT_WORDS = ["leiria"]
TITLE_NOISE = (
    "de da do das dos e em no na o a os as ao aos para com por sobre ate um uma uns umas the of and festa festas festival festivais feira feiras romaria romarias arraial arraiais "
    "evento eventos programa programacao edicao edicoes honra memoria comemoracao comemoracoes celebracao celebracoes realizacao ano anos dia dias mes meses noite noites"
).split()

MUNICIPALITIES = (
    "Alcobaça", "Alvaiázere", "Ansião", "Batalha", "Bombarral", "Caldas da Rainha", "Castanheira de Pêra", "Figueiró dos Vinhos",
    "Leiria", "Marinha Grande", "Nazaré", "Óbidos", "Pedrógão Grande", "Peniche", "Pombal", "Porto de Mós",
)
MUNICIPALITY_ALIASES = {"leira": "Leiria", "leiria e arredores": "Leiria"}
PARISHES = {
    "Alcobaça": (
        "Alfeizerão",
        "Aljubarrota",
        "Bárrio",
        "Benedita",
        "Cela",
        "Évora de Alcobaça",
        "Maiorga",
        "Pataias",
        "São Martinho do Porto",
        "Tremoceira",
        "Turquel",
        "Vestiaria",
    ),
    "Ansião": (
        "Alvorge",
        "Avelar",
        "Chão de Couce",
        "Pousaflores",
        "Santiago da Guarda",
    ),
    "Caldas da Rainha": (
        "Carvalhal Benfeito",
        "Foz do Arelho",
        "Ribafria",
        "Salir do Porto",
        "Tornada",
    ),
    "Leiria": (
        "Bajouca",
        "Barosa",
        "Barreira",
        "Bidoeira de Baixo",
        "Bidoeira de Cima",
        "Caranguejeira",
        "Carreira",
        "Carvide",
        "Chainça",
        "Coimbrão",
        "Colmeias",
        "Cortes",
        "Graça",
        "Guia",
        "Maceira",
        "Maceirinha",
        "Marrazes",
        "Memória",
        "Milagres",
        "Monte Real",
        "Ortigosa",
        "Parceiros",
        "Pedrógão",
        "Picos",
        "Pousos",
        "Regueira de Pontes",
        "Santa Eufémia",
    ),
    "Marinha Grande": (
        "Ordem",
        "São Pedro de Moel",
        "Vieira de Leiria",
    ),
    "Nazaré": (
        "Valado dos Frades",
    ),
    "Óbidos": (
        "A-dos-Negros",
        "Gaeiras",
        "Olho Marinho",
        "Sobral da Lagoa",
        "Usseira",
        "Vau",
    ),
    "Peniche": (
        "Atouguia da Baleia",
        "Ferrel",
        "Serra d'El-Rei",
    ),
    "Porto de Mós": (
        "Alcaria",
        "Alqueidão da Serra",
        "Alvados",
        "Arrimal",
        "Calvaria de Cima",
        "Juncal",
        "Mendiga",
        "Mira d'Aire",
        "Mira de Aire",
        "São Bento",
        "São Jorge",
        "Serro Ventoso",
    ),
}
# Localities that only the district gate knows.
GATE_PARISHES = (
    "amieira",
    "telhada",
    "vilar",
    "lameiro",
    "montes",
    "pelos",
    "casal dos arcade",
    "pedreiras",
    "martinganca",
    "junceira",
)
KNOWN_VENUES = (("O Pica Miolos", ("Pica Miolos",), "Leiria"),)
TITLE_PHRASES = ("caldas da rainha", "marinha grande", "porto de mos", "castanheira de pera", "pedrogao grande", "figueiro dos vinhos")
TITLE_SINGLES = ("alcobaca", "alvaiazere", "ansiao", "bombarral", "leiria", "nazare", "obidos", "peniche")

CATEGORIES = (
    "Cultura", "Música", "Concertos", "Festivais", "Festas", "Clubbing", "Teatro", "Dança", "Cinema", "Literatura", "Encontros", "Conferências", "Workshop", "Museus & Exposições",
    "Mercados e Feiras", "Tradição", "Infantil", "Comedy", "Desporto", "Gastronomia", "Natureza", "Atividades ao Ar Livre", "Outros",
)
# A label that sources use and the canonical label or labels that it means.
CATEGORY_ALIASES = {
    "Concerto": ("Concertos",),
    "Teatro e Dança": ("Teatro", "Dança"),
    "Performance": ("Teatro",),
    "Danças": ("Dança",),
    "Cinema e Vídeo": ("Cinema",),
    "Exibição": ("Cinema",),
    "Museus": ("Museus & Exposições",),
    "Exposições": ("Museus & Exposições",),
    "Exposição": ("Museus & Exposições",),
    "Biblioteca": ("Literatura",),
    "Lançamento de livro": ("Literatura",),
    "Conversa": ("Encontros",),
    "Conferência": ("Conferências",),
    "Palestra": ("Conferências",),
    "Fórum": ("Conferências",),
    "Apresentações, conferências e encontros": ("Conferências", "Encontros"),
    "Oficina": ("Workshop",),
    "Oficina pedagógica": ("Workshop",),
    "Formação": ("Workshop",),
    "Oficinas": ("Workshop",),
    "Oficina / workshop": ("Workshop",),
    "Feira": ("Mercados e Feiras",),
    "Feiras": ("Mercados e Feiras",),
    "Eventos": ("Cultura",),
    "Jornadas Europeias do Património": ("Cultura",),
    "Animação Infantil": ("Infantil",),
    "Mais Novos": ("Infantil",),
    "Stand Up Comedy": ("Comedy",),
    "Stand-up Comedy": ("Comedy",),
    "Bem Estar": ("Desporto",),
    "Corrida": ("Desporto",),
    "Caminhada": ("Desporto",),
    "Passeios e Visitas": ("Outros",),
    "Visita guiada": ("Outros",),
    "Percurso / Roteiro": ("Outros",),
    "Lazer": ("Outros",),
    "Outros eventos": ("Outros",),
    "Evento": ("Outros",),
    "Outras": ("Outros",),
    "Jogos": ("Outros",),
    "Fotografia": ("Outros",),
    "Agenda": ("Outros",),
    "CM Leiria": ("Outros",),
    "Espetáculo": ("Outros",),
    "Saúde": ("Outros",),
    "Educação": ("Outros",),
    "Festival": ("Festivais",),
    "Ambiente": ("Natureza",),
    "Evento ao ar livre": ("Atividades ao Ar Livre",),
    "Eventos ao ar livre": ("Atividades ao Ar Livre",),
}
DROPPED_CATEGORIES = ("Shotgun", "Eventbrite", "Ticketline", "Viral Agenda")

MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()
WEEKDAYS = ("segunda-feira", "terça-feira", "quarta-feira", "quinta-feira", "sexta-feira", "sábado", "domingo")
# Named references that sources emit.
ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "hellip": "…",
    "ndash": "–",
    "mdash": "—",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "laquo": "«",
    "raquo": "»",
    "ordm": "º",
    "ordf": "ª",
    "deg": "°",
    "aacute": "á",
    "acirc": "â",
    "agrave": "à",
    "atilde": "ã",
    "auml": "ä",
    "eacute": "é",
    "ecirc": "ê",
    "iacute": "í",
    "oacute": "ó",
    "ocirc": "ô",
    "otilde": "õ",
    "uacute": "ú",
    "ccedil": "ç",
    "Aacute": "Á",
    "Acirc": "Â",
    "Atilde": "Ã",
    "Eacute": "É",
    "Ecirc": "Ê",
    "Iacute": "Í",
    "Oacute": "Ó",
    "Ocirc": "Ô",
    "Otilde": "Õ",
    "Uacute": "Ú",
    "Ccedil": "Ç",
    "nbsp": " ",
}

# Words after which a venue in prose ends, in any case.
VENUE_STOPS = (
    "Mais inform",
    "Página",
    "Bilhetes",
    "Inscri",
    "Crianças",
    "Entrada",
    "Participação",
    "Duração",
    "a partir das",
    "Nos dias",
)
# Values of a venue that say it is not known yet.
JUNK_VENUES = ("a confirmar", "a definir", "a anunciar")
DEFAULT_VENUE = "CM Leiria"
# What stands in a venue field when no venue was typed; a row of dashes means the same.
VENUE_PLACEHOLDERS = ("evento", "eventos", "local", "local a definir", "a definir", "sem local", "n/a")
COUNTRY_PLACEHOLDERS = ("portugal", "portugal continental", "pt")
# Labels that name a channel and not a subject.
PSEUDO_CATEGORIES = ("Evento", "Homepage | Agenda", "Newsletter | Evento Destaque", "Newsletter | Eventos Listagem")
# Parts of venue slugs of the area.
VENUE_KEYWORDS = ("leiria", "miguel_franco", "lucio", "santana", "sant_ana", "castelo_de_leiria", "mimo")
# Values that stand for a time that is not known.
PLACEHOLDER_TIMES = ("", "N/D", "T00:59", "00:59")
# Days that an announcement without a year may lie ahead.
ANNOUNCE_DAYS = 150
# Genres of a hub and what they mean.
GENRE_CATEGORIES = {
    "literatura": "Literatura",
    "conferencia": "Conferências",
    "rock-pop": "Concertos",
    "jazz": "Concertos",
    "musica-classica": "Concertos",
    "opera": "Concertos",
    "folk": "Concertos",
    "eletronica": "Clubbing",
    "exposicao": "Museus & Exposições",
    "festival": "Festivais",
    "cinema": "Cinema",
    "infantil": "Infantil",
    "teatro": "Teatro",
    "performance": "Teatro",
    "outro": "Outros",
}
# Concelhos outside the district that listings name.
OUTSIDE_CONCELHOS = (
    "agueda",
    "albergaria-a-velha",
    "almada",
    "amadora",
    "aveiro",
    "barcelos",
    "beja",
    "braga",
    "braganca",
    "cascais",
    "castelo branco",
    "coimbra",
    "covilha",
    "espinho",
    "evora",
    "faro",
    "figueira da foz",
    "guarda",
    "guimaraes",
    "leca da palmeira",
    "lisboa",
    "loures",
    "maia",
    "matosinhos",
    "montijo",
    "oeiras",
    "olhao",
    "ovar",
    "penafiel",
    "portimao",
    "porto",
    "povoa de varzim",
    "santarem",
    "setubal",
    "sintra",
    "tomar",
    "torres vedras",
    "valongo",
    "viana do castelo",
    "vila do conde",
    "vila franca de xira",
    "vila nova de famalicao",
    "vila nova de gaia",
    "vila real",
    "viseu",
)

# The hubs of an aggregator, one a district; the first is the catalogue's own.
HUBS = ["leiria", "acores", "aveiro", "beja", "braga", "braganca", "castelo-branco", "coimbra", "evora", "faro", "guarda", "lisboa", "madeira", "portalegre", "porto", "santarem", "setubal", "viana-do-castelo", "vila-real", "viseu"]

# Councils whose agendas share one form: host, prefix of ids, name.
COUNCILS = [
    ("www.cm-mgrande.pt", "mg", "Marinha Grande"),
    ("www.cm-nazare.pt", "nz", "Nazaré"),
    ("www.cm-batalha.pt", "bt", "Batalha"),
    ("www.cm-alvaiazere.pt", "av", "Alvaiázere"),
    ("www.cm-ansiao.pt", "an", "Ansião"),
    ("www.cm-peniche.pt", "pn", "Peniche"),
    ("www.cm-pedrogaogrande.pt", "pg", "Pedrógão Grande"),
]
