"""Word classes and class patterns of abusive, hateful and sexually explicit writing (English and Norwegian, some Danish and Swedish).

No sentences are listed: a pattern is a sequence of classes, so that "I hope you choke", "I hope they burn" and "håper du
drukner" are one pattern. Words are given as they are spelled; disguises are undone before they are looked up.
"""

CLASSES = {
    # who is spoken to or of
    "you": "you your youre yours yourself yourselves ya u du deg din ditt dine dere deres dig dej",
    "them": "them they those him her hers he she his their dem de ham henne han hun hans hennes disse denne gjengen",
    "all": "all every everyone everybody alle hele samtlige enhver whole lot",
    "i": "i we ill id im jeg vi jag vil",
    "people": """
people folk women woman men girls boys wives immigrants immigrant foreigners foreigner refugees refugee migrants muslims muslim jews jew christians gypsies gypsy
gays homosexuals lesbians blacks whites arabs asians africans mexicans indians lawyers workers bosses
kvinner kvinne kvinnfolk damer jenter menn mannfolk innvandrere innvandrer utlendinger utlending flyktninger flyktning asylsøkere muslimer jøder jøde kristne sigøynere romfolk homofile
lesber svarte arabere afrikanere asiater samer polakker svensker tyskere
""",
    # nouns that demean a person when said of one
    "insult": """
idiot idiots moron morons imbecile imbeciles cretin cretins halfwit dimwit nitwit scumbag scumbags asshole assholes arsehole arseholes bastard bastards bitch bitches shit shithead shitheads
dickhead dickheads cunt cunts whore whores slut prick pricks twat twats wanker wankers tosser motherfucker motherfuckers fucker fuckers loser losers retard retards dumbass jackass douchebag
douche bellend skank hag
tulling tullinger taper tapere drittsekk drittsekker drittkjerring kjerring kjerringer hore horer rasshol rasshøl rasshull rævhøl hestkuk kuk kukhode fitte fitter fittetryne dust dusten dumming
sjonsk kødd kødder svin drittunge jævel jævler faens æsel idioten tosk mongo sinke evneveik
skitstovel skitstøvel røvhul røvhuller kælling luder kusse skitstövel hora subba
""",
    # nouns that demean with a curse or scorn beside them
    "weak": "cow cows pig pigs dog dogs rat trash garbage rubbish filth waste dirt clown clowns fool fools freak freaks creep creeps ku gris griser hund hunder søppel avfall dritt møkk klovn tosker kryp",
    # words for a group of people that are abusive by themselves
    "slur": "nigger niggers nigga kike kikes spic spics chink chinks faggot faggots fag fags tranny trannies paki pakis raghead ragheads wetback wetbacks towelhead svarting svartinger pakkis pakkiser soper sopere neger negre",
    # nouns that deny people their humanity
    "dehuman": """
vermin rats parasites animals scum cockroaches subhumans savages leeches pests maggots pigs apes monkeys beasts cancer plague
utøy rotter parasitter dyr avskum skadedyr undermennesker kakerlakker svin apekatter aper utskudd pakk berme udyr mark pest
skadedjur råttor parasiter djur undermänniskor
""",
    # adjectives and curses that add to an insult
    "strong": """
stupid worthless pathetic filthy disgusting brainless fucking damn damned goddamn bloody subhuman thieving diseased dirty ugly useless rotten lousy dumb fat
ynkelig udugelig udugelige hjernedød hjernedøde stygg stygge forbanna forbannet forbannede jævla undermåls tjuvaktige tyvaktige skitne skitten syke fordømte fordømt helvetes faens feit feite dum dumme ussel elendige verdiløse verdiløs ekle ekkel
jävla förbannade satans
""",
    # what kills or hurts: of someone, and by someone
    "dies": "die dies choke chokes rot rots burn burns drown drowns suffer suffers crash suffocate perish bleed dø dør daue drukne drukner kveles brenne brenner råtne råtner lide lider krepere kreperer forsvinne brekker brekke knekker",
    "hit": "hit run knocked raped killed stabbed shot beaten cancer påkjørt overkjørt drept voldtatt skutt knivstukket kreft",
    "harm": """
kill stab shoot hurt beat break smash burn strangle cut slit murder rape crush punch kick bash destroy slaughter skin butcher hunt drepe dreper stikke skyte skyter knuse knuser banke banker brekke
brekker brenne kvele kveler knekke knekker voldta voldtar slakte slakter skade skader slå slår myrde myrder
""",
    "drive": "run drive ram mow kjøre kjører meie meier",
    "at": "at into over down på inn ned straight",
    "body": "bone bones neck face throat skull teeth legs kneecaps head bein beinet beina nakke nakken tryne trynet ansikt ansiktet strupe halsen tenner tennene hodet kropp kroppen",
    "self": "yourself yourselves deg selv dig",
    "suicide": "kill hang drown shoot heng drukn skyt",
    "leap": "jump leap hopp hoppe",
    "height": "bridge cliff roof building quay pier balcony train window broa broen bru klippe taket bygning kaia brygga balkongen toget vinduet",
    "weight": "stone rope brick noose neck stein tau løkke halsen",
    "favour": "favour favor tjeneste",
    # what a speaker wants done, and how
    "hope": "hope hopes wish håper ønsker hoppas håpe",
    "will": "ill will shall gonna going wanna want wants would ll skal kommer vil ska",
    "must": "should must ought deserve deserves need fortjener burde bør må skal borde förtjänar",
    "deserve": "deserve deserves fortjener förtjänar",
    "beating": "beating thrashing whipping hanging juling bank pryl stryk",
    "expel": "deported exterminated gassed shot hanged hung killed wiped eradicated sterilised sterilized castrated lynched executed burned burnt drowned slaughtered utryddes utryddet gasses gasset skytes henges drepes steriliseres kastreres lynsjes brennes druknes slaktes deporteres",
    "chase": "driven chased kicked thrown hunted jages jaget kastes kastet hives sparkes",
    "out": "out away ut vekk bort",
    "toss": "throw dump drive kick push load hiv kast jag dump last",
    "sea": "sea ocean river overboard sjøen havet elva overbord",
    "vessel": "boat boats ship raft båt båten skip skuta flåte",
    "sinking": "bottom sink sinking leaking goodbye farewell bunn synke synker lekk farvel",
    "put": "put set load sent send sett settes setter sendes send lastes",
    "no": "no not never ingen ikke aldri nobody noone",
    "right": "right rights rett rettigheter",
    "exist": "live exist breathe breed vote reproduce leve eksistere puste formere stemme",
    "allowed": "allowed permitted get få lov tillates",
    "nobody": "nobody noone ingen",
    "miss": "miss love loves like likes wants mourn cry savne savner elske elsker liker gråte gråter sørge",
    "error": "mistake accident error abortion feil feiltagelse uhell misfoster",
    "born": "birth born conception fødsel fødselen født",
    "mother": "mother mom mum mama parents father mor mora mamma foreldre far morra",
    "shame": "shame ashamed disgust disgusted hate hates regret regrets embarrassed skam skamme skammer hater angrer avsky",
    "curse": "fuck fucking fucked damn faen fan helvete jævla satan dritt shit forpult",
    "kitchen": "kitchen zoo cage gutter sewer trash dump asylum chains kjøkkenet kjøkken dyrehage bur rennestein søpla søppelet lenker",
    "belong": "belong belongs tilhører hører",
    "waste": "waste bortkastet sløsing",
    "oxygen": "space air oxygen skin flesh plass luft oksygen",
    "from": "came come kom kommer",
    "back": "back home tilbake hjem",
    "go": "go get crawl piss fuck dra gå reis stikk",
    "hell": "hell helvete hælvete helvede",
    # sexual writing
    "explicit": """
fuck fucking fucked knulle knuller knulla pule puler porn porno pornomodeller pornomodell milf milfs nude nudes tits boobs pussy cock cocks dick xxx sluts slutty horny
kinky ludder puppene puppe pupper sexkamera sexcam nakenbilder nakenbilde kåte kåt slibrige slibrig blowjob blowjobs handjob handjobs cumshot cumshots cum orgasm dildo dildos threesome gangbang anal hardcore
runke runker onani onanere kneppe kneppes sex clips nakne naked escorts deepthroat strippers
""",
    # of these, the ones that need another one beside them
    "mild": "sex clips nakne naked nude fucking xxx porn porno kinky tits slibrige slibrig horny kåte kåt fuck fucked boobs onani onanere orgasm dildo dildos pule puler pupper puppe cock cocks dick anal hardcore escorts strippers cum",
    "lover": "women wives girls ladies damer jenter husmødre models modeller pornomodeller sluts ludder milfs teens escorts babes kvinner",
    "suck": "suck sucks lick licks ride suge suger slikke slikker ri",
    "spread": "spread spreads spre sprer",
    "legs": "legs thighs beina bena lårene",
    "show": "show shows flash flashes send sends vise viser sende sender",
    "breasts": "tits boobs pussy ass puppene puppe pupper fitta fitte rumpa rumpe",
    "nudes": "nudes nakenbilder nakenbilde",
    "act": "fuck screw bang knulle pule kneppe",
    "undress": "undress strip kle ta take kneel",
    "clothes": "everything clothes panties dress alt klærne klær trusa",
    "lie": "lie bend kneel legg bøy knel spread",
    "threatplace": "where hvor",
    "know": "know knows vet",
    "lives": "live lives bor sleep sleeps sover",
    # the speaker turns to someone
    "address": "you your youre du din ditt dine deg dere is are am was were er var som like such everyone whoever what hva they he she han hun de hver alle all",
    "be": "is are am was were er var ar",
    "article": "a an en et ei",
    # reports, rules, medicine, trades and animal care, where such words mean other things
    "neutral": """
court courts judge judges police convicted sentenced fined prosecutor defendant trial appeal policy policies guideline guidelines warning rights minorities seminar lecture education workshop campaign
patient patients doctor nurse hospital disease screening diagnosis symptoms prostate breast fertility contraception
valve shaft cylinder cylinders clamp cable drawer socket hinge pump exterminated exterminator bedding cellar trap traps traps poison pest control
zoo farm farms veterinary vet species wildlife livestock lab laboratory breeding dictionary defined meaning
tingretten lagmannsretten domstol politiet dømte dømt bot bøter ytringer retningslinjer retningslinjene advarsel kurs kurset foredrag kampanje minoriteter
pasient pasienter lege sykehus sykdom helse brystkreft prostata prevensjon fruktbarhet
ventil aksling sylinder klemme skuff pumpe utryddet kjelleren felle feller gift skadedyrkontroll veterinær dyrlege dyrehage husdyr dyrevern gårdsbruk arter laboratorium ordbok leksikon betydning låser lås
""",
    # made of a term and one of these right after it, a word is the name of a kind, as in "bastard file"
    "kind": "file nut switch mix valve clamp saw title",
    # punished for what they said
    "verdict": "fined sentenced convicted warned banned dømte dømt bøtelagt advart utestengt",
}

#: Points of a class pattern, and its classes in order ("a|b": either); each at most GAP words after the one before.
PATTERNS = [
    # wishes of harm, threats, incitement
    (1.0, "hope you|them|people dies|hit"), (1.0, "i will harm you|them|body|people|all"), (1.0, "harm i you|them|body|people|all"), (1.0, "i will drive at you|them|people|all"), (1.0, "i will drive you|them at"), (1.0, "drive i at you|them|people|all"),
    (1.0, "favour leap|suicide|dies"), (1.0, "leap height weight"), (1.0, "know threatplace you lives"), (0.5, "know threatplace them lives"),
    (1.0, "you|them|people|dehuman must expel"), (1.0, "you|people|dehuman must chase out"), (0.6, "them must chase out"), (1.0, "you|them|people|all|dehuman must put vessel sinking"), (1.0, "must put you|them|people|all vessel sinking"), (1.0, "you|them|people|dehuman deserve beating|dies"), (0.6, "toss you|them|people|all sea"),
    # rights and worth denied
    (1.0, "no right exist"), (1.0, "you|them|people must no allowed exist"), (1.0, "nobody will|must miss you|them"), (1.0, "nobody miss you"), (1.0, "you error born"), (1.0, "must no born"), (0.6, "you mother shame"), (0.6, "mother you shame"), (0.6, "mother shame"),
    (1.0, "you|them|people belong kitchen"), (1.0, "waste oxygen"), (1.0, "go back you from"), (1.0, "curse you shame"), (1.0, "must curse shame"), (1.0, "must shame curse"), (0.5, "must shame self"),
    # sexual offers and demands
    (1.0, "lover suck you"), (1.0, "suck explicit"), (1.0, "spread legs"), (1.0, "show breasts"), (1.0, "show nudes"), (1.0, "will act you|them"), (1.0, "will you act"), (1.0, "undress clothes lie"),
]
#: Points of words that stand right beside one another.
IDIOMS = [
    (0.6, "shut up"), (0.6, "hold kjeft"), (0.6, "get lost"), (0.6, "piss off"), (1.0, "fuck off"), (1.0, "fuck you"), (1.0, "screw you"), (1.0, "faen ta deg"), (1.0, "go to hell"), (1.0, "rot in hell"), (1.0, "burn in hell"), (1.0, "dra til helvete"), (1.0, "til helvete med"),
    (1.0, "kill yourself"), (1.0, "hang yourself"), (1.0, "drown yourself"), (1.0, "shoot yourself"), (1.0, "heng deg"), (1.0, "drukn deg"), (1.0, "skyt deg"), (1.0, "drep deg"),
    (1.0, "drop dead"), (1.0, "go die"), (1.0, "go and die"), (1.0, "gå og dø"), (1.0, "ta livet av deg"), (1.0, "piece of shit"), (1.0, "pieces of shit"), (1.0, "son of a bitch"), (0.6, "scum of the earth"), (1.0, "full of shit"),
]
#: Classes of which a sentence must have a word to be looked at.
TRIGGERS = "insult weak slur dehuman strong dies harm body suicide leap expel chase beating sea sinking nobody born shame curse kitchen waste hell explicit suck legs breasts nudes undress exist lives hope drive from".split()
#: Classes whose words are also looked for in disguise.
DISGUISED = "insult slur dehuman strong explicit curse suck legs shame harm lover nudes breasts".split()
#: Ordinary words that are two swapped letters away from one of these.
ORDINARY = "sult tapre rast arts trial form sign star tars ration pilot hide dire rime tips spit".split()
QUOTES = "\"“”«»„"
