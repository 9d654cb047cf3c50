"""Values as the SQL states them, apart from those of the functions, so that neither can hide the other's slip.

Fixed values throughout.
"""

STOPWORDS = (
    "'the', 'a', 'an', 'of', 'to', 'in', 'on', 'for', 'and', 'or', 'as', 'at', 'by', 'is', 'are', 'was', 'were', 'be', 'been', 'with', 'from', 'after', "
    "'over', 'under', 'amid', 'says', 'say', 'said', 'report', 'reports', 'news', 'update', 'live', 'breaking', 'its', 'his', 'her', 'their', "
    "'this', 'that', 'these', 'those', 'it', 'he', 'she', 'they', 'we', 'you', 'not', 'no', 'new', 'us', 'into', 'than', 'but', 'will', 'has', 'have', 'had'"
)

NEGATIVE = (
    "kill killed killing dead death dies died war attack bomb bombing strike missile terror terrorist terrorism explosion crash crisis threat "
    "threaten conflict violence violent destroy destroyed destruction collapse sanctions sanction condemn condemned arrest arrested fraud corruption "
    "scandal protest riots riot flee fled refugees famine drought flood earthquake hurricane tornado devastat catastroph emergency victim victims "
    "shoot shooting shot hostage kidnap torture abuse massacre genocide invasion invaded nuclear weapon casualties wounded injured suffer "
    "fail failed failure recession downturn unemployment poverty hunger disease pandemic epidemic outbreak infection contamination"
)
POSITIVE = (
    "peace ceasefire agreement deal treaty accord cooperation aid help rescue rescued relief recovery recover growth prosper success "
    "elect elected democratic freedom liberat reform progress improve breakthrough milestone achievement victory win won celebrate hope "
    "safe secure security protect humanitarian donate donation support build rebuild develop development summit diplomacy diplomatic negotiate "
    "resolution resolve reconciliation reunite alliance partner partnership"
)

URGENCY = """case when regexp_matches(c, '^(conflict|cyber|military|radiation|space weather)') then 'critical'
  when regexp_matches(c, '^(natural disaster|health|displacement)') then 'warning'
  when regexp_matches(c, '^(government|sanctions|aviation)') then 'advisory'
  when regexp_matches(c, '^(economic|supply chain|prediction|trade|humanitarian)') then 'monitoring'
  when regexp_matches(c, '^(infrastructure|ai/ml|caching|compute|proxy|imagery|visual)') then 'system' else 'neutral' end"""

ACRONYM_STOPLIST = (
    "'AI', 'AKA', 'AM', 'APP', 'ASAP', 'BST', 'CEO', 'CFO', 'COO', 'CPI', 'CTO', 'DIY', 'ETA', 'EUR', 'EV', 'FAQ', 'FYI', 'GDP', 'GMT', 'GPS', 'HR', 'ID', "
    "'IPO', 'IT', 'JR', 'ML', 'NEW', 'OK', 'PDF', 'PM', 'PR', 'Q1', 'Q2', 'Q3', 'Q4', 'SR', 'TV', 'URL', 'USD', 'VIP', 'VP', 'VPN'"
)

#: Capitalised phrases that are no persons.
PERSON_STOPLIST = (
    "'new year', 'good friday', 'black friday', 'cyber monday', 'prime minister', 'president trump', "
    "'president biden', 'president putin', 'vice president', 'secretary general', 'secretary state', 'chief justice', "
    "'attorney general', 'joint chiefs', 'king charles', 'pope francis', 'al jazeera', 'fox news', "
    "'sky news', 'wall street', 'new york', 'los angeles', 'san francisco', 'las vegas', "
    "'hong kong', 'sri lanka', 'south korea', 'north korea', 'south africa', 'new zealand', "
    "'el salvador', 'costa rica', 'sierra leone', 'burkina faso', 'ivory coast', 'white house', "
    "'capitol hill', 'downing street', 'world cup', 'olympic games', 'nobel prize', 'supreme court', "
    "'world bank', 'red cross', 'red sea', 'black sea', 'south china', 'east china', "
    "'breaking news', 'live updates', 'just in', 'read more', 'click here', 'sign up', "
    "'photo credit', 'getty images', 'associated press', 'bangkok post', 'the hill', 'the times', "
    "'the intercept', 'the guardian', 'the telegraph', 'hacker news', 'war zone', 'military times', "
    "'task purpose', 'chosun ilbo', 'el pais', 'air force', 'coast guard', 'national guard', "
    "'samsung electronics', 'atlantic council', 'world food', 'food programme', 'homeland security', 'ben gurion', "
    "'united nations', 'european union', 'read full', 'full article', 'morning briefing', 'evening briefing', "
    "'world war', 'cold war', 'civil war', 'black hawk', 'golden fleet', 'epic fury', "
    "'power plants', 'fort bragg'"
)

#: Words that no person's name holds, and those that only fill a headline.
NO_NAME_WORDS = (
    "'post', 'times', 'news', 'zone', 'journal', 'monitor', 'tribune', 'herald', 'gazette', "
    "'observer', 'telegraph', 'intercept', 'briefing', 'digest', 'report', 'review', 'service', 'english', "
    "'force', 'forces', 'security', 'organization', 'organisation', 'programme', 'program', 'affairs', 'council', "
    "'committee', 'ministry', 'bureau', 'agency', 'command', 'corps', 'division', 'department', 'commission', "
    "'authority', 'institute', 'association', 'foundation', 'federation', 'airport', 'material', 'materials', 'plants', "
    "'plant', 'nuclear', 'vulnerability', 'vulnerabilities', 'exploited', 'fleet', 'awards', 'network', 'operating', "
    "'innovation', 'revolution', 'operations', 'war', 'article', 'full', 'read', 'says', 'adds', "
    "'known', 'linked', 'uses', 'stealthy', 'morning', 'afternoon', 'evening', 'update', 'special', "
    "'general', 'fury', 'hawk', 'leaving', 'international', 'humanitarian', 'population', 'world'"
)
FILLERS = (
    "'the', 'on', 'in', 'at', 'of', 'for', 'and', 'or', 'but', 'why', 'how', 'who', "
    "'what', 'when', 'where', 'its', 'his', 'her', 'our', 'their', 'this', 'that', 'one', 'two', "
    "'most', 'some', 'all', 'any', 'new', 'old', 'big', 'very', 'just', 'also', 'than', 'each'"
)

#: Titles before a person's name, in the order they are tried.
NAME_TITLES = (
    "president", "vice president", "director", "secretary", "minister", "prime minister",
    "senator", "governor", "ambassador", "chairman", "general", "admiral",
    "colonel", "major", "captain", "commander", "chief", "state",
    "deputy", "former",
)

AD_LINKS = "'/cnn-underscored', '/deals/', '/shopping/', '/ad/', '/sponsored/', '/partner-content/', '/brandcontent/', '/paid-partner/', '/commerce/', '/coupons/', '/product-reviews/', 'affiliate', '/buy/', '/shop/'"

AD_TITLES = (
    "^ad:|^sponsored|^promoted|^advertisement|^underscored|cnn underscored|best .{0,30} deals|best .{0,30} to buy|best .{0,30} for 20\\d\\d|"
    "best .{0,30} we''?ve tested|our favorite .{0,40} of 20\\d\\d|top \\d+ .{0,30} (deals|products|gifts)|shop .{0,30} sale|\\d+% off .{0,30}|coupon code|"
    "promo code|gift guide|deals of the day|sale alert|save \\$?\\d+|discount code|black friday|cyber monday|prime day|where to buy|buying guide|price drop|"
    "cash ?back card|home equity (loan|line|into cash)|home equity$|into cash you can use|cash out of your home|credit card interest|avoid .{0,20}credit card|"
    "intro apr|\\d+% apr|0% .{0,15}(apr|interest|intro)|balance transfer|best .{0,20} card of|best .{0,20} credit card|best .{0,20} rewards card|"
    "best .{0,20} travel card|best .{0,20} savings (account|rate)|high.yield savings|refinanc(e|ing) (your|a|the)|mortgage rate|insurance (rate|quote|plan)|"
    "personal loan|debt (consolidat|relief|pay)|student loan (refin|forgiv|rate)|experts:.{0,30}(card|loan|rate|account|insur)|"
    "it''?s official:.{0,30}(card|credit|interest|rate|apr)|dream big with|rising .{0,15}equity|turn your .{0,30}(equity|home)|"
    "want cash .{0,20}(out|from) .{0,15}home|\\b(visa|mastercard|amex|discover)\\b.{0,20}(card|offer|reward)|subscribe (now|today|to)|"
    "sign up for .{0,20} newsletter|download our app|^horoscope|^daily horoscope|^your .{0,15} horoscope|^crossword|^wordle|^today.s puzzle"
)
FINANCIAL_AD_TITLES = (
    "credit card|cash ?back|home equity|\\bapr\\b|\\bloan\\b|\\bmortgage\\b|\\brefinanc|\\binsurance\\b.{0,15}(rate|quote|plan|cost)|\\bsavings (account|rate)|"
    "\\binterest rate|\\bdebt (consolidat|relief|pay)|your (home|money|credit|debt|rate|savings|equity)|experts:.{0,5}(this|the|best)|it''?s official|dream big|"
    "cash (out|you can)|turn your|\\b(visa|mastercard|amex)\\b|\\bintro (rate|apr|offer)|\\b0%.{0,10}(apr|interest|intro)|best .{0,20}(card|rate|account)|"
    "avoid .{0,15}(interest|fee|charge)|high.yield|\\bCD rate|balance transfer|personal (loan|finance)|student loan"
)


def listed(words: str) -> str:
    return ", ".join(f"'{w}'" for w in words.split())


def stems(words: str) -> str:
    return "|".join(w for w in words.split() if len(w) >= 6)
