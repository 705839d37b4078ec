from math import exp

import numpy as np
import pytest

from tidewatch.functions import special as S


def test_tails_against_textbook_values():
    assert S.normal_sf2(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert S.student_t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert S.student_t_sf2(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    assert S.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert S.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert S.chi2_sf(4.0, 2) == pytest.approx(exp(-2), abs=1e-14)


def test_poisson_cdf_is_the_sum():
    assert S.poisson_cdf(2, 3.0) == pytest.approx(exp(-3) * (1 + 3 + 4.5), abs=1e-12)
    assert S.poisson_cdf(-1, 3.0) == 0


@pytest.mark.parametrize("counts", [[500, 300, 150, 50, 0, 0], [1000, 400, 100, 30, 5, 1], [1000]])
def test_richness(counts):
    x = np.array(counts)
    total = x.sum()
    depths = S.log_depths(total, 20)
    curve = [S.expected_richness(x, d) for d in depths]
    assert depths[-1] == total and curve[-1] == pytest.approx((x > 0).sum())
    assert curve == sorted(curve) and S.expected_richness(x, 0) == 0
    assert S.expected_richness(x, 1) == pytest.approx(1)


def test_required_depth_round_trip():
    from tidewatch.operators.planning import Plan

    plan = Plan(0.0005)
    assert plan.sensitivity(plan.required_depth(0.95)) >= 0.95
    assert Plan(0.001, min_reads=1).sensitivity(3000) == pytest.approx(1 - exp(-3))
    assert Plan(0.001).cost(2e6) == 60
    for bad in (Plan(0), Plan(0.1, min_reads=0)):
        with pytest.raises(ValueError):
            bad.required_depth(0.9)
    with pytest.raises(ValueError):
        Plan(0.1).required_depth(1.0)
