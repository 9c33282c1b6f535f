"""Word lists. All of them are fixed values: results depend on exactly these entries."""

from __future__ import annotations

EXCESS_VOCABULARY = frozenset(
    "delve delves delving delved underscore underscores underscoring underscored showcase showcases showcasing showcased pivotal crucial crucially realm realms"
    " intricate intricacies intricately meticulous meticulously nuanced nuance robust comprehensive comprehensively multifaceted holistic leverage leverages"
    " leveraging harness harnesses harnessing landscape landscapes tapestry testament beacon myriad plethora paramount vital noteworthy commendable invaluable"
    " groundbreaking transformative unprecedented profound profoundly seamless seamlessly unwavering cutting-edge state-of-the-art game-changer aligns aligning"
    " boasts garnered garner surpasses surpassing advancements underpinning fostering cultivate elevate elevates streamline streamlining empower empowering unlock"
    " unlocking resonate resonates reimagine redefine revolutionize spearhead ever-evolving fast-paced".split()
)
DOMAIN_WORDS = frozenset("robust landscape vital realm nuance nuanced comprehensive harness".split())

FUNCTION_WORDS = frozenset(
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can cannot could couldn't did"
    " didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he her here hers herself him himself his"
    " how i if in into is isn't it its itself let me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same"
    " shan't she should shouldn't so some such than that the their theirs them themselves then there these they this those through to too under until up very was"
    " wasn't we were weren't what when where which while who whom why with won't would wouldn't you your yours yourself yourselves will shall may might must can't"
    " i'm you're it's we're they're i've we've don t s".split()
)

FINITE_FORMS = frozenset(
    "is are was were be been being am do does did done have has had having can could will would shall should may might must get gets got go goes went come comes"
    " came make makes made take takes took see sees saw know knows knew think thinks thought say says said work works worked run runs ran sit sits sat find finds"
    " found give gives gave fit fits hold holds held stand stands stood mean means meant keep keeps kept want wants need needs seem seems turn turns put puts let"
    " lets thank thanks look looks ask asks tell tells show shows call calls try tries read reads use uses map maps drop drops".split()
)

POSITIVE = frozenset(
    "good great best better wonderful excellent beautiful happy joy joyful love loved loving warm bright hope hopeful gentle kind calm peace peaceful smile smiled"
    " laugh laughed light delight delighted pleasure proud pride success succeed win won triumph gift lucky safe comfort comforted tender sweet rich clear strong"
    " brilliant perfect amazing glad grace graceful free freedom generous thrill thrilled charm charming bloom flourish gleam glow radiant".split()
)
NEGATIVE = frozenset(
    "bad worse worst awful terrible ugly sad sorrow grief cry cried tears pain painful hurt wound wounded dark darkness fear afraid scared anger angry rage hate"
    " hated hatred cruel cold bitter harsh lonely alone loss lost fail failed failure broken break shattered ruin ruined empty hollow dead death dying kill killed"
    " violence sick illness ache aching dread despair numb regret shame ashamed guilt guilty betray betrayed abandon abandoned".split()
)

PRONOUNS = frozenset("i we you he she it they me us him her them this that these those there".split())
PLAIN_OPENERS = frozenset("the it and but a i we this that so".split())
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "St", "vs", "etc", "al", "Fig", "Eq", "approx", "cf", "e.g", "i.e")

NEGATORS = frozenset(
    "not no never nothing none nor isn't isnt aren't arent wasn't wasnt doesn't doesnt don't dont didn't didnt hasn't hasnt haven't havent won't wont can't cant"
    " cannot couldn't couldnt".split()
)
STRONG_NEGATORS = NEGATORS - {"no", "nothing", "none", "nor"}
