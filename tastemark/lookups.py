"""Word lists, replacement tables, thresholds and points.

Everything in this module is data that results depend on; no logic lives here.
"""

# Category keywords that mark a restaurant, short list.
CATEGORY_KEYWORDS_SHORT = (
    "Restaurants|Bakeries|Foods|Coffee|Tea|Desserts|food|Cupcakes|cafes|Breakfast|Lunch|Dinner"
)

# Category keywords that mark a restaurant, city catalogue list.
CATEGORY_KEYWORDS = (
    "restaurant|Bar|Bakeries|food|Coffee|Tea|Waffles|Desserts|sandwiches|Cupcakes|cafes|Breakfast|Brunch|Lunch|Dinner"
    "|chicken|wings|singaporean|malaysian|indonesian|russian|taiwanese|american|vietnamese|moroccan|cantonese|caribbean"
    "|mideastern|asian|italian|korean|himalayan|african|nepalese|laotian|sushi|hawaiian|mediterranean|caterers|fish"
    "|chips|fishnchips|thai|salad|chinese|seafood|irish|portuguese|french|vegan|raw_food|pizza|latin|lebanese|burgers"
    "|gluten-free|japanese|pakistani|mexican|sushi|argentine|lounges|barbeque|canadian|dimsum|halal|afghan|donuts|juice"
    "|smoothies|bagels|ramen|icecream|pubs|falafel|noodles|soup|cheese|colombian|turkish|ethiopian|peruvian|hungarian"
    "|ukrainian|indian|persian|brazilian|vegetarian|austrian|arabian|haitian|cambodian|german|greek|Barbeque|Buffets"
    "|Cajun/Creole|Cajun|Cuban|Czech|Delis|Diners|Filipino|Festivals|Hot Dogs|Hot Pot|Macarons|Modern European|Nightlife"
    "|Salvadoran|Venezuelan|tapas|australian|kosher|wine|creperies|cafe|bangladeshi|cakes|brasseries|cideries|smokehouse"
    "|patisserie|hindu|hong kong|hakka|veggies|plates|hkcafe|spanish|grilling"
)

# Category keywords of businesses that are not restaurants.
CATEGORY_DENY = (
    "acupuncture|grocery|bookstores|musicvideo|yoga|servicestations|convenience|homeappliancerepair|appliances|Repair"
    "|bike|repair|Used|toys|wholesale|supplies|hair|barbers|Hair Salons|Archery|Adult Entertainment|Amateur Sports Teams"
    "|Airport Lounges|Vinyl Records|Pilates|fitness|Real Estate Agents|Real Estate Services|Recreation Centers"
    "|Reflexology|massage|Tattoo|Traditional Chinese Medicine|Trainers|Walking Tours|Virtual Reality Centers"
    "|Musical Instrument Services|Laser Tag|Community Service/Non-Profit|Flea Markets|Tours|Golf|Hotels|Kids Activities"
    "|Accessories|Bartending Schools|audio|foodbanks|barreclasses|bartenders|kitchenandbath|cosmetics|Bed & Breakfast"
    "|bowling|boxing|teambuilding|casinos|Centers|movietheaters|musicalinstrumentsandteachers|colleges|couriers"
    "|Customized Merchandise|gyms|escapegames|videogamestores|gift|goods|laundromat|martial|muaythai|eventplanning"
    "|Performing Arts|personalchefs|pets|piano|sportsteams|schools|spas|tobaccoshops|vape|wedding_planning|winetours"
    "|beer_and_wine|Wineries|hvac|winetastingroom|hindu_temples|fireplace|artclasses|Arcades|galleries"
    "|Personal Shopping|Strip Clubs|grillingequipment|herbsandspices|bubbletea"
)

# Aliases of single places left out, and aliases taken back in.
ALIAS_DENY = (
    "8090-ktv-toronto|soho-ktv|prestige-by-night-toronto|hard-luck-bar|ktv|mimico-pub-and-grill|bar-karaoke-lounge"
    "|lighthouse-shisha-lounge|arabica-lounge|Purdy|dried-nuts-and-fruits|tangs-company|the-painted-lady|baby-g"
    "|Coalition|bassline-music-bar|underground-garage|cadillac-lounge|internet-cafe|super-tech|netconnect-cafe|invictus"
    "|gigabites|internet|penta-q|freshly-squeezed-toronto"
)
ALIAS_ADD_BACK = (
    "tasty-pot|pho-saigon-restaurant|kin-kin-bakery-and-bubble-tea|hk-sweets|mika-sushi|next-station|green-grotto"
)

# Categories never shown in a recommendation list.
UNWANTED_CATEGORIES = "Barber|Desserts|Bakeries|Tea Rooms"

# The six named origin points (name, latitude, longitude).
ORIGINS = (
    ("yonge_and_finch", 43.779824, -79.415665),
    ("bloor_and_bathurst", 43.665194, -79.411208),
    ("queen_and_spadina", 43.648772, -79.396259),
    ("bloor_and_yonge", 43.670409, -79.386814),
    ("dundas_and_yonge", 43.6561, -79.3802),
    ("spadina_and_dundas", 43.653004, -79.398082),
)

# Price label (number of $ signs) to words.
PRICE_WORDS = {1: "inexpensive", 2: "moderately priced", 3: "premium priced", 4: "fine dining"}

# Tokens that end a negation scope (matched as substrings).
NEGATION_RESETS = (",", ".", "?", ";", "however", "but")

# English function words left out of term counts (common public stop list).
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his "
    "himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had having do does did doing a an the and but "
    "if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don don't should "
    "should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't "
    "haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't "
    "weren weren't won won't wouldn wouldn't"
).split()
STOP_WORDS_EXTRA = ["not_the"]
# Stop words that stay inside a phrase.
PHRASE_KEEP = ("is", "was", "are", "were")

# Nouns too general to highlight.
HIGHLIGHT_NOUN_STOP = (
    "place restaurant food amount experience side size location quality taste thing order bowl night day flavour spot "
    "portion dish meal good drink time everything get delivery nice customer one"
).split()

# Domain valences that extend or override a sentiment lexicon.
VALENCE_OVERRIDES = {
    "excellent": 3.99, "amazing": 3.981, "awesome": 3.98, "best": 3.98, "wonderful": 3.979, "authentic": 3.97,
    "incredible": 3.97, "incredibly": 3.97, "popular": 3.96, "well-known": 3.96, "delicious": 3.95, "tasty": 3.94,
    "five-star": 3.91, "fanciest": 3.89, "finest": 3.89, "fast": 3.88, "phenomenal": 3.88, "exceptional": 3.83,
    "exceptionally": 3.83, "extrodinary": 3.82, "magnificent": 3.82, "famous": 3.81, "fantastic": 3.8, "splendid": 3.7,
    "yummy": 3.7, "flavorful": 3.699, "flavourful": 3.699, "delightful": 3.69, "decent": 3.6, "unique": 3.6,
    "flavored": 3.5, "fancy": 3.5, "quick": 3.1, "classic": 3.0, "fresh": 3.0, "xoxo": 0.0, "fine": 0.1, "please": 0.0,
    "yeah": 0.0,
}

# Contraction -> long form (the first form where usage allows two), applied in this order.
CONTRACTIONS = {
    "ain't": "am not", "aren't": "are not", "can't": "cannot", "can't've": "cannot have", "'cause": "because",
    "could've": "could have", "couldn't": "could not", "couldn't've": "could not have", "didn't": "did not",
    "doesn't": "does not", "don't": "do not", "hadn't": "had not", "hadn't've": "had not have", "hasn't": "has not",
    "haven't": "have not", "he'd": "he had", "he'd've": "he would have", "he'll": "he shall",
    "he'll've": "he shall have", "he's": "he has", "how'd": "how did", "how'd'y": "how do you", "how'll": "how will",
    "how's": "how has", "i'd": "I had", "i'd've": "I would have", "i'll": "I shall", "i'll've": "I shall have",
    "i'm": "I am", "i've": "I have", "isn't": "is not", "it'd": "it had", "it'd've": "it would have",
    "it'll": "it shall", "it'll've": "it shall have", "it's": "it has", "let's": "let us", "ma'am": "madam",
    "mayn't": "may not", "might've": "might have", "mightn't": "might not", "mightn't've": "might not have",
    "must've": "must have", "mustn't": "must not", "mustn't've": "must not have", "needn't": "need not",
    "needn't've": "need not have", "o'clock": "of the clock", "oughtn't": "ought not",
    "oughtn't've": "ought not have", "shan't": "shall not", "sha'n't": "shall not", "shan't've": "shall not have",
    "she'd": "she had", "she'd've": "she would have", "she'll": "she shall", "she'll've": "she shall have",
    "she's": "she has", "should've": "should have", "shouldn't": "should not", "shouldn't've": "should not have",
    "so've": "so have", "so's": "so as", "that'd": "that would", "that'd've": "that would have", "that's": "that has",
    "there'd": "there had", "there'd've": "there would have", "there's": "there has", "they'd": "they had",
    "they'd've": "they would have", "they'll": "they shall", "they'll've": "they shall have", "they're": "they are",
    "they've": "they have", "to've": "to have", "wasn't": "was not", "we'd": "we had", "we'd've": "we would have",
    "we'll": "we will", "we'll've": "we will have", "we're": "we are", "we've": "we have", "weren't": "were not",
    "what'll": "what shall", "what'll've": "what shall have", "what're": "what are", "what's": "what has",
    "what've": "what have", "when's": "when has", "when've": "when have", "where'd": "where did",
    "where's": "where has", "where've": "where have", "who'll": "who shall", "who'll've": "who shall have",
    "who's": "who has", "who've": "who have", "why's": "why has", "why've": "why have", "will've": "will have",
    "won't": "will not", "won't've": "will not have", "would've": "would have", "wouldn't": "would not",
    "wouldn't've": "would not have", "y'all": "you all", "y'all'd": "you all would",
    "y'all'd've": "you all would have", "y'all're": "you all are", "y'all've": "you all have", "you'd": "you had",
    "you'd've": "you would have", "you'll": "you shall", "you'll've": "you shall have", "you're": "you are",
    "you've": "you have",
}
# Compounds written as one token, applied in this order.
COMPOUNDS = {
    "ice cream": "ice-cream", "hot pot": "hot-pot", "icecream ": "ice-cream", "hotpot": "hot pot",
    "dim sum": "dim-sum", "dimsum": "dim-sum", "egg tart": "egg-tart", "eggtart": "egg-tart",
}

# Evaluation cut-offs, list length, split shares, neighbourhood sizes.
EVAL_CUTOFFS = (5, 10, 15, 20, 50)
LIST_LENGTH = 50
SPLIT_RATIO = (0.5, 0.2, 0.3)
LIKE_THRESHOLD = 3
FOLD_IN_NEIGHBOURS = 110
SWEEP_NEIGHBOURS = tuple(range(50, 120, 10))
