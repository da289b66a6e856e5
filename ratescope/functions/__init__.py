from ratescope.functions.expressions import *  # noqa: F403
