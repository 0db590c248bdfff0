"""Default stop words. Every function that uses them takes another list as an argument."""

# Fixed values
ENGLISH = tuple(
    """
    about above after again against all also am an and any are as at be because been before being
    below between both but by can cannot could did do does doing down during each either else ever
    few for from further had has have having he hence her here hers herself him himself his how
    however if in into is it its itself just many may me might mine more most much must my myself
    neither never no nor not now of off often on once only or other our ours ourselves out over own
    per perhaps rather same she should since so some such than that the their theirs them themselves
    then there therefore these they this those though through thus to together too toward under
    until up upon us very was we were what when where whether which while who whole whom whose why
    will with within without would yet you your yours yourself
    """.split()
)
